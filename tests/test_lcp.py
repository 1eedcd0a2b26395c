import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.functions import lcp


def slow_cut(x):
    """The definition, position by position."""
    found, n = [], len(x)
    for i in range(n - 2):
        j = i + 1
        while j < n and x[j] == x[i + 1]:
            j += 1
        if j < n and x[i] != x[i + 1] and j - i - 1 >= 2:
            found.append((i, j))
        elif x[i] > x[i + 1] < x[i + 2]:
            found.append((i, i + 2))
        elif x[i] < x[i + 1] > x[i + 2] and i >= 1 and i + 3 < n and x[i - 1] <= x[i] and x[i + 2] >= x[i + 3]:
            found.append((i, i + 2))
    out = []
    for k, (a, b) in enumerate(found):
        if k and found[k - 1][1] + 1 < a:
            out.append((found[k - 1][1], a))
        out.append((a, b))
    return out


def as_pairs(x):
    return list(zip(*(v.tolist() for v in lcp.cut(np.array(x)))))


@pytest.mark.parametrize("seq, want", [("ACCT", [(0, 4)]), ("CAC", [(0, 3)]), ("", []), ("AC", []), ("AAAA", []), ("ACGT", []), ("TACGTGCAT", None)])
def test_hand_made(seq, want):
    start, end, label = lcp.parse(seq)
    if want is not None:
        assert list(zip(start, end)) == want
    assert all(0 <= v < 2**60 for v in label.tolist())


def test_label_is_the_documented_hash():
    assert lcp.parse("CAC")[2].tolist() == [int(hashlib.md5(b"1|0|3|1").hexdigest()[:15], 16)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_cut_is_the_definition(x):
    assert as_pairs(x) == slow_cut(x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_cut_over_larger_alphabets(x):
    assert as_pairs(x) == slow_cut(x)


def test_segments_end_at_other_letters_and_case_does_not_matter():
    a, b = lcp.parse("ACCTNACCT"), lcp.parse("ACCT")
    assert a[0].tolist() == [0, 5] and a[2].tolist() == b[2].tolist() * 2
    assert lcp.parse("acct")[2].tolist() == b[2].tolist()


def test_cores_are_local():
    rng = random.Random(5)
    x = "".join(rng.choice("ACGT") for _ in range(400))
    y = x[:200] + ("A" if x[200] != "A" else "C") + x[201:]
    for level, reach in ((1, 12), (2, 80)):
        near = lambda s: {(a, b, c) for a, b, c in zip(*map(list, lcp.parse(s, level))) if b < 200 - reach or a > 200 + reach}
        assert near(x) == near(y)


def test_levels_shrink_and_cover_bases():
    rng = random.Random(6)
    x = "".join(rng.choice("ACGT") for _ in range(5000))
    counts = [len(lcp.parse(x, k)[0]) for k in (1, 2, 3, 4)]
    assert counts == sorted(counts, reverse=True) and counts[3] > 0
    for k in (2, 3, 4):
        start, end, _ = lcp.parse(x, k)
        assert (end > start).all() and end.max() <= 5000


def whole(x, level):
    """Cores of one segment without chunks."""
    codes = np.array([lcp.CODES[c] for c in x], np.int64)
    first, last = lcp.cut(codes)
    labels, start, end = lcp.label_cores(codes, first, last), first, last + 1
    for _ in range(level - 1):
        if len(labels) < 2:
            return []
        symbols, tokens, start, end = lcp.reduce_labels(labels), labels[1:], start[1:], end[1:]
        first, last = lcp.cut(symbols)
        labels, start, end = lcp.label_cores(tokens, first, last), start[first], end[last]
    return list(zip(start.tolist(), end.tolist(), labels.tolist()))


@settings(max_examples=250, deadline=None)
@given(st.text("ACGT", min_size=3, max_size=150), st.integers(1, 4), st.integers(1, 40))
def test_chunks_do_not_show(x, level, chunk):
    x = x + x[:20] * 2 + "A" * (len(x) % 9)
    assert list(zip(*(v.tolist() for v in lcp.parse(x, level, chunk)))) == whole(x, level)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ACGTN", max_size=60)), max_size=12), st.integers(1, 4))
def test_many_records_at_once(records, level):
    got = [row for batch in lcp.parse_records(records, level) for row in zip(*(v.tolist() for v in batch))]
    want = [(k, *row) for k, seq in enumerate(records) if seq for row in zip(*(v.tolist() for v in lcp.parse(seq, level)))]
    assert sorted(got) == sorted(want)


def test_long_sequences_in_chunks():
    rng = random.Random(10)
    x = "".join(rng.choice("ACGT") * rng.choice([1, 1, 1, 2, 40]) for _ in range(4000))
    for level in (1, 2, 3, 4):
        assert list(zip(*(v.tolist() for v in lcp.parse(x, level, 97)))) == whole(x, level)


def test_coin_tossing():
    assert lcp.reduce_labels(np.array([4, 6, 6, 7])).tolist() == [2 * 1 + 1, lcp.EQUAL, 2 * 0 + 1]


def test_spark_forms_agree(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 120)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "record long, seq string")
    a = {tuple(r) for r in lcp.cores(df).select("record", "start", "end", "label", "len").collect()}
    assert a == {tuple(r) for r in lcp.cores_by_window(df).collect()}
    assert a == {(k, s, e, v, e - s) for k, seq in rows if seq for s, e, v in zip(*map(lambda z: z.tolist(), lcp.parse(seq)))}


def test_both_strands(spark):
    df = spark.createDataFrame([(1, "AACGT")], "record long, seq string")
    out = {r["strand"]: r["seq"] for r in lcp.both_strands(df).collect()}
    assert out == {"+": "AACGT", "-": "ACGTT"}
    back = lcp.both_strands(lcp.both_strands(df).where("strand = '-'").drop("strand")).where("strand = '-'").first()["seq"]
    assert back == "AACGT"


def test_level_is_checked(spark):
    with pytest.raises(ValueError):
        lcp.cores(spark.createDataFrame([("A",)], "seq string"), 0)


def test_labels_are_md5_of_the_content():
    content = np.array([[3, 0, 4, 2], [2**60 - 1, 7, 3, 0]])
    told = [int(hashlib.md5("|".join(map(str, row)).encode()).hexdigest()[:15], 16) for row in content.tolist()]
    assert lcp.labels_of(content).tolist() == told


def test_distinct_rows_do_not_hang_on_their_mix():
    """Rows that share a mix, made by undoing its first round, are still told apart."""

    def first_round(x):
        y = (x * 0x9E3779B97F4A7C15) % 2**64
        return y ^ (y >> 29)

    twin = 5 ^ first_round(1) ^ first_round(2)
    unlike = np.array([[1, 5], [2, twin - 2**64 if twin >= 2**63 else twin], [1, 5]])
    for rows in (unlike, np.random.default_rng(1).integers(0, 3, (500, 4))):
        one, which = lcp.distinct_rows(rows)
        assert len(one) == len({tuple(r) for r in rows.tolist()}) and (rows[one[which]] == rows).all()
