"""Command line: ``python -m matchloom STEP ...`` with the steps prepare, train, predict, tune, score and profile.

Steps hand each other Parquet tables in the work folder. A table carries the options that it was made with in its
name, so a step is skipped where a table of the same options is there, unless ``--overwrite`` is given."""

from __future__ import annotations

import argparse
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import half, normalize
from matchloom.operators import blocking, decide, dictionary, evaluate, features, model, profile, sampling
from matchloom.session import ship
from matchloom.sources import tables


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    p.add_argument("step", choices=("prepare", "train", "predict", "tune", "score", "profile"))
    p.add_argument("--data-dir", required=True, help="holds SPLIT/SPLIT_source{1,2,3}.tsv and SPLIT/SPLIT_ground_truth.tsv")
    p.add_argument("--work-dir", required=True)
    p.add_argument("--split", default="train")
    p.add_argument("--countries", nargs="*", help="only these; word weights still come from all")
    p.add_argument("--k", type=int, default=10, help="candidates per channel")
    p.add_argument("--min-count", type=int, default=3, help="how often a word pair must be seen to enter the dictionary")
    p.add_argument("--query-frac", type=float, default=0.2, help="share of half A's records to train on")
    p.add_argument("--neg-frac", type=float, default=0.5)
    p.add_argument("--rounds", type=int, default=40, help="trees")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--threshold", type=float)
    p.add_argument("--country-threshold", nargs="*", default=[], metavar="COUNTRY=T")
    p.add_argument("--support", type=float)
    p.add_argument("--lone", type=float)
    p.add_argument("--by-country", action="store_true", help="also tune a threshold for each country")
    p.add_argument("--rules", action="store_true", help="also tune the rules on whole entities")
    p.add_argument("--dry-run", action="store_true", help="tune without saving")
    p.add_argument("--limit", type=int, help="read the first rows of each source only")
    p.add_argument("--half-a-words", action="store_true", help="learn the dictionary from half A's entities only, so that tuning on half B sees none of its words")
    p.add_argument("--folds", type=int, default=0, help="also score the training pairs by models that haven't seen their entity, in so many folds")
    p.add_argument("--overwrite", action="store_true")
    return p


#: The options that each table depends on, besides those of the tables it is made from.
DEPENDS = {
    "dictionary": ("limit", "min_count", "half_a_words"), "records": ("split",), "candidates": ("k",), "pairs": ("query_frac", "seed", "countries"),
    "model": ("neg_frac", "rounds"), "best": ("split", "countries"), "oof": ("folds",),
}
CHAIN = {
    "dictionary": (), "records": ("dictionary",), "candidates": ("dictionary", "records"), "pairs": ("dictionary", "candidates"),
    "model": ("dictionary", "candidates", "pairs"), "best": ("dictionary", "candidates"), "oof": ("dictionary", "candidates", "pairs", "model"),
}


class Steps:
    def __init__(self, spark: SparkSession, o: argparse.Namespace):
        self.spark, self.o = spark, o
        self.settings_path = f"{o.work_dir}/settings.json"
        self.made: dict[str, DataFrame] = {}

    def options(self, table: str) -> str:
        """A short name of all options that a table depends on."""
        names = sorted({n for t in (table, *CHAIN[table]) for n in DEPENDS[t]})
        return hashlib.sha256(json.dumps({n: getattr(self.o, n) for n in names}, sort_keys=True).encode()).hexdigest()[:8]

    def truth(self, split: str | None = None) -> DataFrame:
        split = split or self.o.split
        return tables.read_truth(self.spark, f"{self.o.data_dir}/{split}/{split}_ground_truth.tsv")

    def kept(self, name: str, make, options: str, split: str | None = None) -> DataFrame:
        """A table of the work folder, made once a run at most."""
        path = f"{self.o.work_dir}/{split or self.o.split}/{name}-{options}"
        if path not in self.made:
            self.made[path] = tables.stage(self.spark, path, make, self.o.overwrite)
        return self.made[path]

    def raw(self, split: str | None = None) -> tuple[DataFrame, DataFrame]:
        split = split or self.o.split
        paths = [f"{self.o.data_dir}/{split}/{split}_source{i}.tsv" for i in (1, 2, 3)]
        one, two, three = (tables.read_records(self.spark, p, self.o.limit) for p in paths)
        return one, two.unionByName(three)

    def words(self):
        """The dictionary, learnt from the training split whatever the split at hand."""

        def make():
            entities, queries = self.raw("train")
            other = entities.where(half(F.col("entity_id")) == 1).select(F.col("entity_id").alias("s1_id")) if self.o.half_a_words else None
            return dictionary.learn(queries, self.truth("train"), entities, self.o.min_count, other)

        return dictionary.as_words(self.kept("dictionary", make, self.options("dictionary"), "train"))

    def records(self) -> tuple[DataFrame, DataFrame]:
        entities, queries = self.raw()
        options = self.options("records")
        return tuple(self.kept(name, lambda rows=rows: normalize(rows, self.words()), options) for name, rows in (("entities", entities), ("queries", queries)))

    def candidates(self) -> DataFrame:
        return self.kept("candidates", lambda: blocking.block(*self.records(), self.o.k), self.options("candidates"))

    def pairs(self, chosen: DataFrame | None = None) -> DataFrame:
        entities, queries = self.records()
        all_ = self.candidates()
        some = all_ if chosen is None else chosen
        if self.o.countries:
            some = some.where(F.col("country").isin(self.o.countries))
        return features.featurize(some, entities, queries, all_)

    def prepare(self) -> None:
        entities, queries = self.records()
        blocking.orphans(entities, queries).groupBy("country").count().show()
        entities.show(5, truncate=60)

    def train(self) -> None:
        _, queries = self.records()
        true = self.truth()
        ours = sampling.record_half(queries, true).where("half = 0").select(F.col("entity_id").alias("query_id"))
        ours = sampling.share(ours, self.o.query_frac, "query_id", seed=self.o.seed)
        labelled = blocking.label(self.candidates(), true).join(ours, "query_id", "left_semi")
        pairs = self.kept("pairs", lambda: self.pairs(labelled), self.options("pairs"))
        how = {"trees": self.o.rounds, "negatives": self.o.neg_frac, "seed": self.o.seed}
        fitted = model.train(pairs, **how)
        name = f"model-{self.options('model')}"
        fitted.write().overwrite().save(f"{self.o.work_dir}/{name}")
        tables.merge_settings(self.spark, self.settings_path, model=name, threshold=0.5, threshold_tuned=False)
        if self.o.folds:
            unseen = self.kept("oof", lambda: model.out_of_fold(pairs, self.o.folds, **how), self.options("oof"))
            print("out of fold: area under ROC", round(model.area_under_roc(unseen), 5))
            model.held_out_quality(unseen).show()
        scored = model.score(pairs, fitted)
        print("area under ROC", round(model.area_under_roc(scored), 5))
        model.held_out_quality(scored).show()
        for name, gain in model.importance(fitted)[:15]:
            print(f"{name:24s} {gain:.3f}")

    def best(self) -> DataFrame:
        from pyspark.ml import PipelineModel

        trained = tables.read_settings(self.spark, self.settings_path)["model"]
        score = lambda: decide.best_owner(model.score(self.pairs(), PipelineModel.load(f"{self.o.work_dir}/{trained}")))
        return self.kept(f"best-{trained}", score, self.options("best"))

    def predict(self) -> None:
        known = tables.read_settings(self.spark, self.settings_path)
        threshold = self.o.threshold if self.o.threshold is not None else known.get("threshold", 0.5)
        by_country = known.get("country_thresholds", {}) | {c: float(t) for c, _, t in (x.partition("=") for x in self.o.country_threshold)}
        given = lambda name: getattr(self.o, name) if getattr(self.o, name) is not None else known.get(f"{name}_threshold")
        matches = decide.accepted(self.best(), threshold, by_country, given("support"), given("lone"))
        entities, _ = self.records()
        out = f"{self.o.work_dir}/output_{self.o.split}"
        tables.write_tsv(decide.match_lists(matches, entities), f"{out}/matching_results")
        tables.write_tsv(decide.candidate_lists(self.candidates(), entities), f"{out}/candidate_pairs")

    def tune(self) -> None:
        entities, _ = self.records()
        ours, true = entities.where(half(F.col("entity_id")) == 1), self.truth()
        best = self.best().join(ours.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        found = {"threshold": evaluate.tune(best, true, ours), "threshold_tuned": True}
        if self.o.by_country:
            points = evaluate.sweep(best, true, ours, evaluate.grid(0.30, 0.985, 0.005), ["country"])
            found["country_thresholds"] = {r["country"]: r["threshold"] for r in evaluate.best_point(points, ["country"]).collect()}
        rules = dict(zip(("support_threshold", "lone_threshold"), evaluate.tune_rules(best, true, ours, found["threshold"]) if self.o.rules else (self.o.support, self.o.lone)))
        found |= {name: value for name, value in rules.items() if value is not None}
        print(found)
        evaluate.report(evaluate.entity_scores(decide.accepted(best, found["threshold"]), true, ours)).show()
        if not self.o.dry_run:
            tables.merge_settings(self.spark, self.settings_path, ("support_threshold", "lone_threshold"), **found)

    def score(self) -> None:
        entities, _ = self.records()
        true = self.truth()
        matches = tables.read_truth(self.spark, f"{self.o.work_dir}/output_{self.o.split}/matching_results")
        evaluate.report(evaluate.entity_scores(matches, true, entities)).show(truncate=False)
        labelled = blocking.label(self.candidates(), true)
        evaluate.ceiling(labelled, true, entities).show()
        evaluate.recall_report(labelled, true).show(50)

    def profile(self) -> None:
        entities, queries = self.raw()
        both, true = entities.unionByName(queries), self.truth()
        for df in (profile.emptiness(both), profile.country_counts(both), profile.match_histogram(entities, true), profile.several_owners(true), profile.across_countries(both, true)):
            df.show(50)


def main() -> None:
    o = arguments().parse_args()
    spark = SparkSession.builder.appName(f"matchloom {o.step}").getOrCreate()
    ship(spark)
    getattr(Steps(spark, o), o.step)()


if __name__ == "__main__":
    main()
