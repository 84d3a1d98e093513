"""The command line and the stream, end to end on files made from the record view."""

import csv

import pytest
from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.__main__ import Steps, arguments
from matchloom.plans.record_view import records, truth
from matchloom.sources import tables
from matchloom.streaming.scoring import match_stream


@pytest.fixture(scope="module")
def files(spark, tiny, tmp_path_factory):
    folder = tmp_path_factory.mktemp("linkage")
    (folder / "data" / "train").mkdir(parents=True)
    raw = records(spark, tiny).cache()
    for i in (1, 2, 3):
        with open(folder / "data" / "train" / f"train_source{i}.tsv", "w", newline="") as f:
            w = csv.writer(f, delimiter="\t")
            w.writerow([c for c in S.RECORD.names])
            w.writerows([r[c] for c in S.RECORD.names] for r in raw.where(F.col("src") == i).collect())
    owned = {}
    for r in truth(raw).collect():
        owned.setdefault(r["s1_id"], []).append(r["query_id"])
    with open(folder / "data" / "train" / "train_ground_truth.tsv", "w") as f:
        f.write("source1_entity_id\tmatched_entity_ids\n")
        f.writelines(f"{r['entity_id']}\t{','.join(sorted(owned.get(r['entity_id'], [])))}\n" for r in raw.where("src = 1").collect())
    return folder


def test_steps_in_order(spark, files, capsys):
    base = ["--data-dir", str(files / "data"), "--work-dir", str(files / "work"), "--query-frac", "1", "--rounds", "3"]
    for step in ("profile", "prepare", "train", "predict", "tune", "predict", "score"):
        options = arguments().parse_args([step, *base, *(["--by-country", "--rules"] if step == "tune" else [])])
        getattr(Steps(spark, options), step)()
    assert tables.read_settings(spark, str(files / "work" / "settings.json"))["threshold_tuned"] is True
    lists = tables.read_tsv(spark, str(files / "work" / "output_train" / "matching_results"), S.GROUND_TRUTH).collect()
    assert len(lists) == 180 and len({r[0] for r in lists}) == 180
    right = {(r["s1_id"], r["query_id"]) for r in tables.read_truth(spark, str(files / "data" / "train" / "train_ground_truth.tsv")).collect()}
    found = {(r[0], q) for r in lists for q in r[1].split(",") if q}
    assert len(found & right) >= 0.8 * len(right) and len(found & right) >= 0.8 * len(found)
    capsys.readouterr()


def matched(spark, work):
    return {r["source1_entity_id"] for r in tables.read_tsv(spark, f"{work}/output_train/matching_results", S.GROUND_TRUTH).collect() if r["matched_entity_ids"]}


def test_kept_tables_know_their_options(spark, files, capsys):
    work = files / "options"
    run = lambda step, *more: getattr(Steps(spark, arguments().parse_args([step, "--data-dir", str(files / "data"), "--work-dir", str(work), "--query-frac", "1", "--rounds", "2", *more])), step)()
    run("train", "--folds", "2")
    run("predict", "--countries", "ASIA")
    some = matched(spark, work)
    run("predict")
    every = matched(spark, work)
    assert 0 < len(some) < len(every) and some < every
    run("predict", "--k", "1")  # other candidates are other tables
    assert len({p.name for p in (work / "train").glob("candidates-*")}) == 2
    run("predict", "--overwrite", "--support", "0.0", "--half-a-words")
    assert matched(spark, work) >= every
    unseen = spark.read.parquet(str(next((work / "train").glob("oof-*"))))
    assert unseen.count() == spark.read.parquet(str(next((work / "train").glob("pairs-*")))).count()
    capsys.readouterr()


def test_another_split_uses_the_words_of_training(spark, files, capsys):
    import shutil

    (files / "data" / "test").mkdir(exist_ok=True)
    for i in (1, 2, 3):
        shutil.copy(files / "data" / "train" / f"train_source{i}.tsv", files / "data" / "test" / f"test_source{i}.tsv")
    options = arguments().parse_args(["prepare", "--data-dir", str(files / "data"), "--work-dir", str(files / "other"), "--split", "test"])
    Steps(spark, options).prepare()  # there is no truth of this split
    assert list((files / "other" / "train").glob("dictionary-*")) and list((files / "other" / "test").glob("entities-*"))
    capsys.readouterr()


def test_stream_matches_as_a_batch_does(spark, tiny, tmp_path):
    raw = records(spark, tiny)
    raw.where("src > 1").drop("src").repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    match_stream(arriving, raw.where("src = 1").drop("src"), str(tmp_path / "out"), str(tmp_path / "progress"), 0.5).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.select("batch").distinct().count() == 3 and rows.count() == rows.select("query_id").distinct().count()
    right = rows.join(truth(raw), ["s1_id", "query_id"]).count()
    assert right >= 0.7 * rows.count()
