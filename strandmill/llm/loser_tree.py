"""A loser tree: the merge of sorted streams with one comparison a level for each item."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def merge_sorted(streams: Iterable[Iterator]) -> Iterator:
    """All items of the sorted ``streams`` in order; of equal items that of the earlier stream first.

    Inner nodes hold the stream that lost the match there, and the winner of all stands above the root. When the winner's
    item is handed on, its stream's next item plays only the losers on the way from its leaf to the root.
    """
    heads, rest = [], []
    for stream in map(iter, streams):
        for item in stream:
            heads.append(item)
            rest.append(stream)
            break
    k = len(heads)
    if not k:
        return
    done = [False] * k
    losers = [-1] * k  # node n has the children 2n and 2n + 1; leaf s is node k + s

    def beats(a: int, b: int) -> bool:
        if done[a] or done[b]:
            return not done[a] if done[a] != done[b] else a < b
        return heads[a] < heads[b] or (a < b and not heads[b] < heads[a])

    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top, left = winners[1], k
    while True:
        yield heads[top]
        for item in rest[top]:
            heads[top] = item
            break
        else:
            done[top] = True
            heads[top] = None
            left -= 1
            if not left:
                return
        node = (k + top) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2
