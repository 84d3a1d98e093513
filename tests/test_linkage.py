"""Rules, scores, files and the whole linkage on the record view."""

import pytest
from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.operators import blocking, decide, evaluate, features, sampling
from matchloom.plans.linkage import Linkage
from matchloom.plans.record_view import records, truth
from matchloom.sources import tables

BEST = "query_id string, s1_id string, country string, prob double"


@pytest.fixture(scope="module")
def sides(spark, tiny):
    raw = records(spark, tiny).cache()
    return raw.where("src = 1").drop("src"), raw.where("src > 1").drop("src"), truth(raw)


def test_f_measure(spark):
    cases = [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 2, 0.8333), (1, 2, 1, 0.5556)]
    df = spark.createDataFrame(cases, "tp int, n_pred int, n_true int, want double")
    for r in df.select("want", evaluate.measure(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f")).collect():
        assert r["f"] == pytest.approx(r["want"], abs=1e-4)


def test_decision_rules(spark):
    scored = spark.createDataFrame([("q1", "a", "x", 0.9), ("q1", "b", "x", 0.9), ("q2", "a", "x", 0.4), ("q3", "c", "y", 0.6), ("q4", "d", "z", 0.55)], BEST)
    best = decide.best_owner(scored)
    ids = lambda df: sorted((r["query_id"], r["s1_id"]) for r in df.collect())
    assert ids(best) == [("q1", "a"), ("q2", "a"), ("q3", "c"), ("q4", "d")]
    assert ids(decide.accepted(best, 0.5)) == [("q1", "a"), ("q3", "c"), ("q4", "d")]
    assert ids(decide.accepted(best, 0.5, by_country={"y": 0.7})) == [("q1", "a"), ("q4", "d")]
    assert ids(decide.accepted(best, 0.5, support=0.3)) == [("q1", "a"), ("q2", "a"), ("q3", "c"), ("q4", "d")]
    assert ids(decide.accepted(best, 0.5, support=0.3, lone=0.58)) == [("q1", "a"), ("q2", "a"), ("q3", "c")]
    entities = spark.createDataFrame([("a",), ("e",)], "entity_id string")
    assert {r[0]: r[1] for r in decide.match_lists(best, entities).collect()} == {"a": "q1,q2", "e": ""}


def test_sweep_equals_one_threshold_at_a_time(spark):
    import random

    r = random.Random(1)
    entities = spark.createDataFrame([(f"e{i}", "xyz"[i % 3]) for i in range(40)], "entity_id string, country string")
    best = spark.createDataFrame([(f"q{i:03}", f"e{r.randrange(40)}", "x", round(r.choice([r.random(), 0.5]), 3)) for i in range(120)], BEST)
    true = spark.createDataFrame([(f"e{r.randrange(40)}", f"q{i:03}") for i in range(0, 120, 2)], "s1_id string, query_id string").unionByName(best.where("query_id < 'q060'").select("s1_id", "query_id")).dropDuplicates(["query_id"])
    grid = evaluate.grid(0.3, 0.9, 0.1)
    got = {x["threshold"]: x["macro_f05"] for x in evaluate.sweep(best, true, entities, grid).collect()}
    for t in grid:
        want = evaluate.entity_scores(decide.accepted(best, t), true, entities).agg(F.avg("f05")).first()[0]
        assert got[t] == pytest.approx(want, abs=1e-8)
    assert evaluate.tune(best, true, entities) in [round(x * 0.005, 3) for x in range(1, 200)]


def test_rules_are_kept_only_if_they_help(spark):
    entities = spark.createDataFrame([(e, "x") for e in "abcd"], "entity_id string, country string")
    best = spark.createDataFrame([("q1", "a", "x", 0.9), ("q2", "a", "x", 0.4), ("q3", "b", "x", 0.62), ("q4", "c", "x", 0.95)], BEST)
    true = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("c", "q4")], "s1_id string, query_id string")
    assert evaluate.tune_rules(best, true, entities, 0.6) == (0.3, 0.63)
    assert evaluate.tune_rules(best.where("query_id in ('q1', 'q4')"), true.where("query_id <> 'q2'"), entities, 0.6) == (None, None)


def test_blocking_finds_the_owners_and_keeps_k(sides):
    entities, queries, true = sides
    linkage = Linkage(entities, queries)
    cands = linkage.block()
    assert cands.groupBy("query_id", "s1_id").count().where("count > 1").count() == 0
    for c in S.CHANNELS:
        assert cands.agg(F.max(f"{c}_rank")).first()[0] <= 10 and cands.where(f"{c}_sim > 1.000001 or {c}_sim <= 0").count() == 0
    assert evaluate.missed_pairs(cands, true).count() <= 0.02 * true.count()
    again = {(r["query_id"], r["s1_id"]) for r in blocking.block(*[d.repartition(7) for d in linkage.normalized()]).collect()}
    assert again == {(r["query_id"], r["s1_id"]) for r in cands.collect()}


def test_all_features_and_the_model(sides):
    entities, queries, true = sides
    linkage = Linkage(entities, queries)
    pairs = linkage.training_pairs(true, share=1.0)
    assert set(S.FEATURES) <= set(pairs.columns) and len(S.FEATURES) == 51
    low = pairs.where((F.col("n_best_gap") > 1e-9) | (F.col("combo_rank") < 0) | (F.col("n_jw") > 1)).count()
    assert low == 0
    from matchloom.operators import model

    fitted = model.train(pairs, trees=4, depth=4)
    scored = linkage.score(fitted)
    best = decide.best_owner(scored)
    assert best.count() == best.select("query_id").distinct().count()
    report = {r["part"]: r for r in linkage.evaluate(decide.accepted(best, 0.5), true).collect()}
    assert report["all"]["macro_f05"] > 0.8
    assert sum(w for _, w in model.importance(fitted)) == pytest.approx(1, abs=1e-6)
    assert model.area_under_roc(model.score(pairs, fitted)) > 0.9


def test_candidates_of_unknown_countries(sides):
    entities, queries, _ = sides
    few = entities.where("country <> 'ASIA'")
    assert blocking.orphans(few, queries).select("country").distinct().collect()[0][0] == "ASIA"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "train").mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for i in (1, 2, 3):
        (tmp_path / "train" / f"train_source{i}.tsv").write_text(head + f'S{i}-1\t"A ""quoted"" name"\t\t US \nS{i}-2\tnull\tx\tIN\n')
    entities, queries = tables.read_split(spark, str(tmp_path), "train")
    row = entities.where("entity_id = 'S1-1'").first()
    assert (row["business_name"], row["business_address"], row["country"]) == ('A "quoted" name', "", "US") and queries.count() == 4
    lists = spark.createDataFrame([("S1-2", ""), ("S1-1", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string")
    tables.write_tsv(lists.coalesce(1), str(tmp_path / "out"))
    assert sorted((r["s1_id"], r["query_id"]) for r in tables.read_truth(spark, str(tmp_path / "out")).collect()) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    path, made = str(tmp_path / "stage"), []
    make = lambda: made.append(1) or entities
    assert tables.stage(spark, path, make).count() == tables.stage(spark, path, make).count() == 2 and len(made) == 1
    settings = str(tmp_path / "settings.json")
    assert tables.read_settings(spark, settings) == {}
    tables.merge_settings(spark, settings, threshold=0.5, lone_threshold=0.6)
    assert tables.merge_settings(spark, settings, drop=("lone_threshold",), threshold=0.7) == {"threshold": 0.7}


def test_a_pair_without_its_record_is_an_error(spark, sides):
    from matchloom.functions.text import normalize

    entities, queries = (normalize(d) for d in sides[:2])
    pairs = blocking.block(entities, queries).where("query_id = 'S2-1'")
    records_ = features.prepared(entities.unionByName(queries), features.word_idf(entities))
    assert features.pair_features(pairs, records_).count() == pairs.count() > 0
    with pytest.raises(Exception, match="no record of S2-1"):
        features.pair_features(pairs, records_.where("entity_id <> 'S2-1'")).collect()


def test_out_of_fold_scores_come_from_models_that_have_not_seen_the_entity(spark, monkeypatch):
    from matchloom.operators import model

    pairs = spark.createDataFrame([(f"q{i}", f"e{i % 40}", i % 2) for i in range(200)], "query_id string, s1_id string, is_match int")
    seen = []

    def train(rows, **options):
        seen.append({r[0] for r in rows.select("s1_id").distinct().collect()})
        return len(seen) - 1

    monkeypatch.setattr(model, "train", train)
    monkeypatch.setattr(model, "score", lambda rows, k: rows.withColumn("prob", F.lit(float(k))))
    rows = model.out_of_fold(pairs, 4).collect()
    assert len(rows) == 200 and all(r["s1_id"] not in seen[int(r["prob"])] for r in rows)


def test_samples_depend_on_ids_alone(sides):
    entities, queries, true = sides
    one = {r[0] for r in sampling.share(queries.select("entity_id"), 0.3, "entity_id").collect()}
    two = {r[0] for r in sampling.share(queries.repartition(9).select("entity_id"), 0.3, "entity_id").collect()}
    assert one == two and 0.2 < len(one) / queries.count() < 0.4
    chosen, others = sampling.dev_sample(entities, queries, true, 40)
    owners = {r["query_id"]: r["s1_id"] for r in true.collect()}
    ids = {r["entity_id"] for r in chosen.collect()}
    assert len(ids) == 40 and all(owners.get(r["entity_id"]) in ids | {None} for r in others.collect())


def test_word_idf_is_capped(spark):
    entities = spark.createDataFrame([("S1-1", "a b b"), ("S1-2", "a c")], "entity_id string, name_main string")
    idf = {r["token"]: round(r["idf"], 6) for r in features.word_idf(entities).collect()}
    assert idf == {"a": round(__import__("math").log(2 / 3), 6), "b": 0.0, "c": 0.0}


def test_the_registered_classifier_has_the_operators_own_size(spark, tiny, monkeypatch):
    from matchloom.operators import model
    from matchloom.plans import catalogue

    class Asked(Exception):
        pass

    def train(pairs, **options):
        raise Asked(options)

    monkeypatch.setattr(model, "train", train)
    with pytest.raises(Asked) as asked:
        catalogue.gbt_matches(spark, tiny)
    assert asked.value.args == ({},)


def test_neighbours_over_shards_and_lanes_by_brute_force(spark, monkeypatch):
    """Pairs that share a token stay within a task; parts of entities and of queries give together what all give."""
    import math
    import random

    r = random.Random(3)
    make = lambda kind, n: [(f"{kind}{i}", r.choice("xy"), " ".join(r.choices("abcdefghij", k=r.randrange(5)))) for i in range(n)]
    entities, queries = make("e", 40), [*make("q", 30), ("alone", "z", "a b")]
    counts = lambda text: {t: text.split().count(t) for t in text.split()}
    want = set()
    for query, country, text in queries:
        own = [(e, counts(t)) for e, c, t in entities if c == country]
        idf = {t: math.log((1 + len(own)) / (1 + sum(t in c for _, c in own))) + 1 for t in {t for _, c in own for t in c}}
        unit = lambda c: {t: (1 + math.log(n)) * idf[t] / math.sqrt(sum(((1 + math.log(m)) * idf[u]) ** 2 for u, m in c.items() if u in idf)) for t, n in c.items() if t in idf}
        asked = unit(counts(text))
        sims = sorted((-round(sum(asked[t] * w for t, w in unit(c).items() if t in asked), 9), e) for e, c in own)
        want |= {(query, e, i + 1, round(-s, 6)) for i, (s, e) in enumerate([x for x in sims if x[0] < 0][:3])}
    of = [blocking.Channel("name", F.filter(F.split("text", " "), lambda x: x != ""), 0.5)]
    tables_ = [spark.createDataFrame(rows, "entity_id string, country string, text string") for rows in (entities, queries)]
    for shard, lane in ((100, 100), (4, 3)):
        monkeypatch.setattr(blocking, "SHARD", shard)
        monkeypatch.setattr(blocking, "LANE", lane)
        tokens = blocking.weighed(tables_[0], of)
        found = blocking.neighbours(blocking.vectors(tables_[1], tokens, of), blocking.vectors(tables_[0], tokens, of), 3)
        assert {(x["query_id"], x["s1_id"], x["rank"], round(x["sim"], 6)) for x in found.collect()} == want


def test_pairs_are_scored_without_their_texts_travelling_beside_them(spark, sides, monkeypatch):
    """Records go to parts once, packed; the context worked out there is that of windows over all pairs."""
    from matchloom.functions.text import normalize

    entities, queries = (normalize(d) for d in sides[:2])
    cands = blocking.block(entities, queries).persist()
    monkeypatch.setattr(features, "TOGETHER", 7)
    rows = features.featurize(cands, entities, queries)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not any("Window" in line or ("Join" in line and "addr_norm" in line) for line in plan.splitlines())
    records_ = features.prepared(entities.unionByName(queries), features.word_idf(entities))
    want = features.context(features.pair_features(cands, records_))
    key = lambda d: {(r["query_id"], r["s1_id"]): [None if r[c] is None else round(r[c], 9) for c in S.FEATURES] for r in d.select("query_id", "s1_id", *S.FEATURES).collect()}
    got = key(rows)
    assert got == key(want) and len(got) == cands.count() > 0


def test_the_search_keeps_no_lineage(sides):
    """Vectors are written, so that the shuffles behind them can be deleted."""
    from matchloom.functions.text import normalize

    found = blocking.block(*[normalize(d) for d in sides[:2]])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "name_main" not in plan and found.where("name_rank = 1").count() > 0


def test_tuning_makes_its_rows_once(spark):
    """Both grids read the same kept rows."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    best = spark.createDataFrame([("q1", "a", "x", 0.9), ("q2", "b", "x", 0.4)], BEST).mapInArrow(counted, BEST)
    entities = spark.createDataFrame([(e, "x") for e in "ab"], "entity_id string, country string")
    true = spark.createDataFrame([("a", "q1")], "s1_id string, query_id string")
    assert evaluate.tune(best, true, entities) == 0.42
    assert made.value == 2


def test_a_querys_lists_are_dealt_out_once(spark, monkeypatch):
    """Equal vectors are looked up once in a task, in several pieces; between vectors and pairs lists cross once, by query."""
    monkeypatch.setattr(blocking, "TOGETHER", 2)
    of = [blocking.Channel("name", F.filter(F.split("text", " "), lambda x: x != ""), 0.5)]
    entities = spark.createDataFrame([(f"e{i}", "x", t) for i, t in enumerate(["a b", "b c", "c d", "a b", "z"])], "entity_id string, country string, text string")
    queries = spark.createDataFrame([(f"q{i}", "x", t) for i, t in enumerate(["a b", "a", "a b", "c", "d", "a", "y"])], "entity_id string, country string, text string")
    tokens = blocking.weighed(entities, of)
    asked, held = (blocking.vectors(d, tokens, of) for d in (queries, entities))
    found = blocking.neighbours(asked, held, 2, keep=lambda d, name: spark.createDataFrame(d.collect(), d.schema))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["s1_id"])
    assert got == {"q0": ["e0", "e3"], "q1": ["e0", "e3"], "q2": ["e0", "e3"], "q3": ["e1", "e2"], "q4": ["e2"], "q5": ["e0", "e3"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert "Join" not in above and above.count("Repartition") == 1
    looked_up = []
    monkeypatch.setattr(blocking.np, "lexsort", lambda keys, f=blocking.np.lexsort: looked_up.append(len(keys)) or f(keys))
    import pyarrow as pa

    table = lambda d, id_: pa.Table.from_pylist([{id_: r["entity_id"], "v": [x.asDict() for x in r["v"]], "ids": [r["entity_id"]]} for r in d.collect()])
    rows, lists = blocking._nearest(table(asked, "query_id"), table(held, "entity_id"), 2)
    assert len(rows) == len(lists) == 6 and looked_up.count(2) == 4 and looked_up.count(3) == 2


def test_pairs_of_the_training_are_featurized_once(spark, monkeypatch):
    """Scoring takes them from the training, and makes features of the other pairs only."""
    from matchloom.operators import model

    asked = []
    ids = lambda d: sorted((r["query_id"], r["s1_id"]) for r in d.collect())
    monkeypatch.setattr(features, "featurize", lambda cands, *_: asked.append(ids(cands)) or cands)
    monkeypatch.setattr(features, "of_prepared", lambda cands, *_: asked.append(ids(cands)) or cands, raising=False)
    monkeypatch.setattr(model, "score", lambda pairs, fitted: pairs)
    record = "entity_id string, business_name string, business_address string, country string"
    entities, queries = (spark.createDataFrame([(f"{kind}{i}", "n", "a", "x") for i in range(12)], record) for kind in "eq")
    pairs = spark.createDataFrame([(f"q{i}", f"e{(i + j) % 12}", "x") for i in range(12) for j in range(3)], "query_id string, s1_id string, country string")
    true = spark.createDataFrame([(f"e{i}", f"q{i}") for i in range(9)], "s1_id string, query_id string")
    linkage = Linkage(entities, queries)
    linkage._kept |= {"candidates": pairs, "prepared": queries}
    linkage.training_pairs(true, share=1.0)
    rows = ids(linkage.score(None))
    assert rows == ids(pairs) == sorted(asked[0] + asked[1]) and 0 < len(asked[0]) < len(rows)


def test_trees_read_vectors_that_are_made_once(spark, monkeypatch):
    """However often the trees read their rows, a pair's features are made once."""
    from matchloom.operators import model

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "query_id string, s1_id string, country string, is_match int, n_ratio double"
    rows = spark.createDataFrame([(f"q{i}", f"e{i % 7}", "x", i % 2, 50.0 * (i % 2)) for i in range(200)], schema).mapInArrow(counted, schema)
    fitted = model.train(rows, trees=2, depth=2)
    assert made.value == 200
    probs = {r["is_match"]: r["prob"] for r in model.score(rows, fitted).collect()}
    assert probs[1] > 0.5 > probs[0]
