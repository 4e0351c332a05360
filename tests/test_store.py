"""The store that grows by batches against one batch over everything."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from litmill import scale
from litmill.operators import logstore, resolve, store

FIELDS = "doi string, pmid string, pmcid string, normalized_title string, publication_year int, first_author string"
SCHEMA = f"record_id long, title string, abstract string, {FIELDS}, authors array<string>, publication_types array<string>, is_retracted boolean"


def record(i, rnd):
    n = rnd.randint(0, 25)
    return (
        i, f"T{n}", rnd.choice([None, "", f"A{i}"]), rnd.choice([None, "", f" 10.1/{n} ", f"10.1/{n}"]), rnd.choice([None, f"{n}"]),
        rnd.choice([None, f"pmc{n}", f"PMC{n}"]), f"t{n}", rnd.choice([None, 2000]), rnd.choice([None, "", "Ann"]),
        rnd.choice([None, [], [f"w{i}", "x"]]), rnd.choice([None, [], ["kind"]]), rnd.random() < 0.1,
    )


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def test_store_equals_snapshots(spark):
    rnd = random.Random(4)
    rows_of = [record(i, rnd) for i in range(240)]
    whole = spark.createDataFrame(rows_of, SCHEMA)
    snapshot = whole.withColumn("article_id", F.lit("")).drop("record_id").limit(0)
    root = scale.new_path(spark, "store")
    kept = logstore.ArticleStore(root, snapshot.schema, buckets=4, fan=2)
    sizes = []
    for batch, part in enumerate([rows_of[:80], rows_of[80:160], rows_of[160:165], []]):
        incoming = spark.createDataFrame(part, SCHEMA)
        for _ in range(2 if batch == 1 else 1):  # a batch that is tried again changes nothing
            kept.upsert(incoming, batch)
        snapshot = scale.stage(store.upsert_articles(snapshot, incoming, store.match_existing(incoming, snapshot)))
        assert rows(kept.articles(spark).select(*snapshot.columns)) == rows(snapshot)
        assert rows(kept.articles(spark, batch)) == rows(kept.articles(spark))
        live = kept.manifests.live(spark, batch)
        sizes.append(sum(live["articles"].values()))
        assert len(live["articles"]) <= 6 and len(live["keys"]) <= 6
    assert kept.manifests.last(spark) == 3
    # Earlier states stay readable; the small batch wrote small runs.
    assert kept.articles(spark, 0).count() <= 80 and sizes[2] - sizes[1] <= 5


def test_long_texts_are_written_as_they_arrive_only(spark):
    rnd = random.Random(7)
    text = lambda: rnd.randbytes(3000).hex()
    one = lambda i, n, abstract: (i, "T", abstract, f"10.1/{n}", None, None, "t", None, None, None, None, False)
    parts = [[one(100 * batch + n, n, "" if batch == 0 and n < 5 else text()) for n in range(40)] for batch in range(3)]
    schema = spark.createDataFrame([], SCHEMA).withColumn("article_id", F.lit("")).drop("record_id").schema
    root = scale.new_path(spark, "store")
    kept = logstore.ArticleStore(root, schema, buckets=4, fan=2)
    size = lambda name: sum(p.stat().st_size for p in Path(root, name).rglob("*.parquet"))
    held = []
    for batch, part in enumerate(parts):
        kept.upsert(spark.createDataFrame(part, SCHEMA), batch)
        held.append(sum(kept.manifests.live(spark, batch)["texts"].values()))
    # Every article was written again in every batch, its text was not.
    assert size("articles") < 40 * 3000
    # The texts of batches 1 and 2 found no article that lacked one, but for five; the rest are left behind by merges.
    assert held == [40, 40, 40]
    want = {f"r{r[0]}": r[2] or parts[1][r[0]][2] for r in parts[0]}
    assert {r["article_id"]: r["abstract"] for r in kept.articles(spark).collect()} == want


def test_key_index_is_not_shuffled(spark):
    rnd = random.Random(5)
    stored = spark.createDataFrame([record(i, rnd) for i in range(80)], SCHEMA).withColumn("article_id", F.concat(F.lit("a"), "record_id"))
    incoming = spark.createDataFrame([record(i, rnd) for i in range(80, 160)], SCHEMA)
    index = logstore.KeyIndex(scale.new_path(spark, "index"), stored.schema["article_id"].dataType, 4)
    index.write(store.long_keys(stored, "article_id").withColumnRenamed("article_id", "owner"), 0)
    hits = index.owners(store.long_keys(incoming, "record_id"), spark, [0])
    assert rows(store.best_match(hits.withColumnRenamed("owner", "article_id"))) == rows(store.match_existing(incoming, stored))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.owners(store.long_keys(incoming, "record_id"), spark, [0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1, plan


def test_forest_equals_one_batch(spark):
    rnd = random.Random(6)
    keys = [(i, kind, f"{kind}{rnd.randint(0, 150)}") for i in range(300) for kind in ("doi", "pmid") if rnd.random() < 0.6]
    keys += [(1000, "doi", "late"), (1001, "pmid", "late")]
    late = [(2000, "doi", "late"), (2000, "pmid", "late"), (-5, "pmid", "late"), (2001, "doi", "doi3"), (2001, "pmid", "pmid7")]
    schema = "record_id long, kind string, value string"
    forest = logstore.ClusterForest(scale.new_path(spark, "forest"), spark.createDataFrame([], schema).schema["record_id"].dataType, 4, 2)
    order = sorted({k[0] for k in keys})
    rnd.shuffle(order)
    parts = [set(order[k::3]) for k in range(3)]
    batches = [[k for k in keys if k[0] in p] for p in parts] + [late]
    seen = []
    for batch, part in enumerate(batches):
        for _ in range(2 if batch == 2 else 1):
            forest.add(spark.createDataFrame(part, schema), batch)
        seen += part
        want = resolve.components(spark.createDataFrame(seen, schema))
        assert rows(forest.clusters(spark)) == rows(want)
    # The late batch wrote its own members and the names it changed, nothing else.
    assert dict(rows(forest.clusters(spark).filter("record_id >= 1000")))["1000"] == "-5"


def test_stored_links_that_repeat(spark):
    kind = "article_id string, url string, format string, landing_url string, is_open_access boolean, is_downloadable boolean, is_preferred boolean, record_seq long"
    twins = [("a", "u", "text", "late", False, True, False, 9), ("a", "u", "html", "early", False, False, True, 2)]
    new = spark.createDataFrame([], kind.replace("record_seq", "seq long, record_seq"))
    for stored in (twins, twins[::-1]):
        got = store.upsert_resources(spark.createDataFrame(stored, kind).coalesce(1), new).first()
        assert (got.format, got.landing_url, got.is_downloadable, got.is_preferred) == ("html", "early", True, True)
