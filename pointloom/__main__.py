"""The programs from a command line: python -m pointloom PROGRAM ...

The files may be ply, pcd, stl or parquet, by extension.
"""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from .plans import pipelines
from .sources import formats
from .storage import stored


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pointloom", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str, text: str, *files: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for f in files:
            p.add_argument(f)
        return p

    p = program("evaluate", "metrics of a reconstruction against the truth", "pred", "truth")
    for name, value in (("down-sample", 0.05), ("threshold", 0.2), ("truncation-acc", 0.5), ("truncation-com", 0.5)):
        p.add_argument(f"--{name}", type=float, default=value)
    p.add_argument("--no-align", dest="align", action="store_false")
    p.add_argument("--no-crop", dest="crop", action="store_false")
    p = program("clean-near-truth", "points near the truth", "source", "truth", "target")
    p.add_argument("--threshold", type=float, default=0.1)
    p.add_argument("--voxel", type=float, default=0.0)
    p = program("clean-knn", "statistical and percentile filters, central cluster", "source", "target")
    for f in fields(pipelines.KnnPreset):
        value = getattr(pipelines.CLI, f.name)
        flag = "--" + f.name.replace("_", "-")
        if isinstance(value, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
        else:
            p.add_argument(flag, type=type(value), default=value)
    p = program("clean-clusters", "statistical and radius filters, largest cluster", "source", "target")
    for name, value in (("k", 25), ("std", 1.8), ("radius", 0.3), ("min-points", 6), ("eps", 0.15), ("min-cluster", 16)):
        p.add_argument(f"--{name}", type=type(value), default=value)
    program("pcd-to-ply", "all attributes, intensity unified", "source", "target")
    p = program("cloud-to-stl", "surface of a cloud", "source", "target")
    for name, value in (("voxel", 0.1), ("down-sample", 0.0), ("smooth", 0.0)):
        p.add_argument(f"--{name}", type=float, default=value)
    p = program("stl-to-cloud", "mesh.ply and a sampled cloud in a folder", "source", "folder")
    p.add_argument("--voxel", type=float, default=0.01)
    p.add_argument("--unit-scale", type=float, default=1.0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("pointloom").getOrCreate()
    program = o.pop("program")
    read = lambda name: formats.read_cloud(spark, o.pop(name))
    if program == "evaluate":
        pred, truth = read("pred"), read("truth")
        for row in pipelines.metrics.report(pipelines.eval_cloud(pred, truth, **o)).collect():
            print(f"{row.metric}: {row.value}")
    elif program in ("pcd-to-ply", "cloud-to-stl", "stl-to-cloud"):
        run = {"pcd-to-ply": pipelines.pcd_to_ply, "cloud-to-stl": pipelines.cloud_to_stl, "stl-to-cloud": pipelines.stl_to_cloud}[program]
        source, target = o.pop("source"), o.pop("folder", None) or o.pop("target")
        run(spark, source, target, **o)
    else:
        cloud, target = read("source"), o.pop("target")
        if program == "clean-near-truth":
            out = pipelines.clean_near_truth(cloud, read("truth"), **o)
        elif program == "clean-knn":
            out = pipelines.clean_knn(cloud, replace(pipelines.CLI, **o))
        else:
            out = pipelines.clean_clusters(cloud, **o)
        out = stored(out, "cleaned")
        formats.write_both(out, target)
        share = pipelines.kept_share(cloud, out).first()
        print(f"kept {share.n_after} of {share.n_before} points ({share.pct_kept:.2f} %)")


if __name__ == "__main__":
    main()
