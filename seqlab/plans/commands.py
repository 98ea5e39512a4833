"""The programs as commands: ``python -m seqlab COMMAND ...``.

Tables are folders or files of Parquet, or CSV and TSV files by their suffix;
results are folders of Parquet, or of CSV with ``--csv``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from seqlab.plans import programs, settings
from seqlab.plans.registry import Library
from seqlab.sources import session_files, tables


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its path's suffix, under internal names."""
    for suffix, sep in ((".csv", ","), (".tsv", "\t")):
        if path.endswith(suffix):
            return tables.to_internal_names(tables.drop_unnamed(tables.read_csv(spark, path, sep=sep)))
    return tables.to_internal_names(spark.read.parquet(path))


def _write(args: argparse.Namespace, **found: DataFrame) -> None:
    for name, rows in found.items():
        if args.csv:
            tables.write_csv(rows, f"{args.out}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")


def _cosine(spark, args):
    groups, subjects = programs.cosine_distances(read_table(spark, args.a), read_table(spark, args.b), usage_threshold=args.usage_threshold)
    _write(args, group_distances=groups, subject_distances=subjects)


def _redundant(spark, args):
    _write(args, merge_map=programs.redundant_labels(read_table(spark, args.resamples), read_table(spark, args.scores), entropy_threshold=args.entropy_threshold, transition_threshold=args.transition_threshold))


def _merge(spark, args):
    frames, percent, stats = programs.merge_labels(read_table(spark, args.frames), read_table(spark, args.merge_map))
    _write(args, frames=frames, percent=percent, stats=stats)


def _flip(spark, args):
    r = programs.flip_quality(read_table(spark, args.frames), read_table(spark, args.labels), read_table(spark, args.flipped), confusion_threshold=args.confusion_threshold, kinematic_threshold=args.kinematic_threshold, fps=args.fps)
    _write(args, agreement=r.agreement, per_label=r.per_label, pairs=r.pairs, candidates=r.candidates, merge_map=r.merge_map)


def _empty(spark, args):
    share, ranges = programs.empty_ranges(read_table(spark, args.frames), empty_threshold=args.empty_threshold, split_threshold=args.split_threshold, filter_size=args.filter_size)
    _write(args, share=share, ranges=ranges)


def _split(spark, args):
    others = dict(x.split("=", 1) for x in args.tables or ())
    r = programs.split_empty({"frames": read_table(spark, args.frames), **{name: read_table(spark, path) for name, path in others.items()}}, height=args.height, empty_threshold=args.empty_threshold, split_threshold=args.split_threshold, filter_size=args.filter_size)
    _write(args, share=r.share, ranges=r.ranges, splits=r.splits, **{f"tables/{name}": rows for name, rows in r.tables.items()})


def _slice(spark, args):
    _write(args, frames=programs.slice_frames(read_table(spark, args.frames), time_slice=(args.start, args.end)))


def _features(spark, args):
    _write(args, features=programs.syllable_features(read_table(spark, args.frames), read_table(spark, args.scores), read_table(spark, args.ar), fps=args.fps or 30.0, duration=args.duration, eig=args.eig))


def _columns(experiments: dict[str, DataFrame], given: Sequence[str] | None) -> list[str]:
    """The given columns, or all numbers that every experiment has but its keys."""
    shared = set.intersection(*({c for c, kind in t.dtypes if kind in ("double", "float", "int", "bigint")} for t in experiments.values()))
    return list(given) if given else sorted(shared - {"syllable_id"})


def _meta(spark, args):
    experiments = tables.read_experiments(spark, args.experiments)
    truth = read_table(spark, args.ground_truth) if args.ground_truth else None
    assigned, table = programs.meta_clusters(experiments, _columns(experiments, args.columns), ground_truth=truth, n_clusters=args.clusters, algorithm=args.algorithm, seed=args.seed)
    _write(args, clusters=assigned, **({} if table is None else {"contingency": table}))


def _generate(spark, args):
    experiments = tables.read_experiments(spark, args.experiments)
    print(programs.generate_library(spark, Library(args.root, spark), experiments, _columns(experiments, args.columns), n_clusters=args.clusters, seed=args.seed))


def _add(spark, args):
    print(programs.add_to_library(spark, Library(args.root, spark), args.version, tables.read_experiments(spark, args.experiments), distance_threshold=args.distance_threshold, create_new_clusters=args.new_clusters))


def _list(spark, args):
    for r in Library(args.root, spark).list_versions(spark, archived=args.archived).collect():
        print(r["version"], r["created"], r["status"])


def _restore(spark, args):
    print(Library(args.root, spark).restore(args.version))


def _treatments(spark, args):
    out = programs.merge_treatments(tables.read_csv(spark, args.file_map, sep="\t"), tables.read_csv(spark, args.dosing, sep="\t"), args.index)
    print(f"{out.where('changed').count()} groups changed")


def _treatments_from_index(spark, args):
    print(f"{programs.merge_treatments_from_index(spark, args.target, args.source).where('found').count()} groups found")


def _extract(spark, args):
    if args.name is None:
        for r in session_files.read_sessions(spark, args.files, "tree").select("name", "dtype").distinct().orderBy("name").collect():
            print(r["name"], r["dtype"])
    else:
        programs.extract_scalar(spark, args.files, args.name, args.out, kind=args.kind)


def _settings(spark, args):
    tables.write_yaml(settings.extraction_settings(args.flip_classifier), f"{args.out}/extraction.yaml")
    tables.write_yaml(settings.component_settings(), f"{args.out}/components.yaml")


def _path(spark, args):
    tables.write_yaml(settings.apply_path(tables.read_yaml(args.settings), args.path, component=args.component), args.settings)


#: Command: (function, places, options by name with their types or defaults).
COMMANDS = {
    "cosine-distances": (_cosine, ("a", "b", "out"), {"usage-threshold": 0.005}),
    "redundant-labels": (_redundant, ("resamples", "scores", "out"), {"entropy-threshold": 0.5, "transition-threshold": 0.25}),
    "merge-labels": (_merge, ("frames", "merge_map", "out"), {}),
    "flip-quality": (_flip, ("frames", "labels", "flipped", "out"), {"confusion-threshold": 0.35, "kinematic-threshold": 0.85, "fps": float}),
    "empty-ranges": (_empty, ("frames", "out"), {"empty-threshold": 10.0, "split-threshold": 150, "filter-size": 9}),
    "split-sessions": (_split, ("frames", "out"), {"tables": list, "height": 10, "empty-threshold": 10.0, "split-threshold": 150, "filter-size": 9}),
    "slice-frames": (_slice, ("frames", "out"), {"start": 0.0, "end": 30.0}),
    "label-features": (_features, ("frames", "scores", "ar", "out"), {"fps": float, "duration": "backward", "eig": "eigh"}),
    "meta-clusters": (_meta, ("experiments", "out"), {"ground-truth": str, "clusters": int, "algorithm": "kmeans", "seed": 0, "columns": list}),
    "library-generate": (_generate, ("root", "experiments"), {"clusters": int, "seed": 0, "columns": list}),
    "library-add": (_add, ("root", "version", "experiments"), {"distance-threshold": 0.65, "new-clusters": False}),
    "library-list": (_list, ("root",), {"archived": False}),
    "library-restore": (_restore, ("root", "version"), {}),
    "merge-treatments": (_treatments, ("file_map", "dosing", "index"), {}),
    "merge-treatments-from-index": (_treatments_from_index, ("target", "source"), {}),
    "extract-scalar": (_extract, ("files", "out"), {"name": str, "kind": "csv"}),
    "settings": (_settings, ("flip_classifier", "out"), {}),
    "apply-path": (_path, ("settings", "path"), {"component": "root"}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqlab", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, places, options) in COMMANDS.items():
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for place in places:
            one.add_argument(place)
        one.add_argument("--csv", action="store_true", help="write CSV")
        for option, kind in options.items():
            if kind is list:
                one.add_argument(f"--{option}", nargs="+")
            elif isinstance(kind, bool):
                one.add_argument(f"--{option}", action="store_true")
            elif isinstance(kind, type):
                one.add_argument(f"--{option}", type=kind)
            else:
                one.add_argument(f"--{option}", type=type(kind), default=kind)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"seqlab {args.command}").getOrCreate(), args)
