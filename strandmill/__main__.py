"""Command line: ``python -m strandmill {fa,fq,ld} -i LIST …`` compares genomes, ``tree FILE.phy …`` grows a tree."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.signature import SET, VECTOR
from .plans import compare

SUFFIX = ".phy"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    programs = top.add_subparsers(dest="program", required=True)
    for name, what in (("fa", "assembled genomes"), ("fq", "sequencing reads"), ("ld", "cores of an earlier run")):
        p = programs.add_parser(name, help=what)
        p.add_argument("-i", dest="paths", required=True, help="file that lists an input for each genome")
        p.add_argument("-l", dest="level", type=int, default=4, help="level of parsing")
        p.add_argument("-s", dest="names", help="file that lists short names")
        p.add_argument("-p", dest="prefix", default="gc", help="prefix of the matrices")
        p.add_argument("-o", dest="outputs", help="file that lists a folder for each genome's cores")
        p.add_argument("--store", dest="core_store", help="folder for the cores of all genomes")
        for side in ("min", "max"):
            one = p.add_mutually_exclusive_group()
            one.add_argument(f"--{side}-cc", dest=f"{side}_cc", type=int, help=f"{side}imum frequency of a core")
            one.add_argument(f"--{side}-cc-file", dest=f"{side}_cc", help=f"file that lists {side}imum frequencies")
        if name == "fa":
            p.add_argument("--window", type=int, help="read files by ranges of bytes and parse records by windows of so many bases")
        mode = p.add_mutually_exclusive_group()
        mode.add_argument("--set", dest="mode", action="store_const", const=SET, default=SET)
        mode.add_argument("--vec", dest="mode", action="store_const", const=VECTOR)
        p.add_argument("--missing", dest="on_missing", choices=("fail", "empty"), default="fail", help="what a missing input means")
        p.add_argument("-v", dest="verbose", action="store_true")
    t = programs.add_parser("tree", help="tree of a matrix")
    t.add_argument("matrix")
    method = t.add_mutually_exclusive_group()
    method.add_argument("--nj", dest="method", action="store_const", const="nj", default="nj")
    method.add_argument("--upgma", dest="method", action="store_const", const="upgma")
    t.add_argument("--normalize", action="store_true", help="divide by the largest distance")
    t.add_argument("--outgroup", help="root at this genome, not at the midpoint")
    return top


def main(args: list[str] | None = None) -> None:
    given = vars(parser().parse_args(args))
    program = given.pop("program")
    spark = SparkSession.builder.appName("strandmill").getOrCreate()
    if program == "tree":
        path = given["matrix"]
        if not path.endswith(SUFFIX):
            raise ValueError(f"a matrix's name ends with {SUFFIX}")
        newick = compare.tree_of(spark, path, given["method"], given["normalize"], given["outgroup"]) + "\n"
        with open(f"{path.removesuffix(SUFFIX)}.{given['method']}.newick", "w") as f:
            f.write(newick)
        print(newick, end="")
        return
    start = {"fa": compare.from_fasta, "fq": compare.from_fastq, "ld": compare.from_cores}[program]
    print("\n".join(start(spark, compare.Run(**given)).write()))


if __name__ == "__main__":
    main()
