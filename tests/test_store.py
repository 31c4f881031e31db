from __future__ import annotations

import json
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from docmill.errors import Conflict, NotFound, RequestError
from docmill.operators.search import search
from docmill.sources.store import Store
from docmill.streaming.ingest import upserts

BODY = {"settings": {"numberOfShards": 3}, "mappings": {"properties": {"title": {"type": "text"}, "category": {"type": "keyword"}, "pages": {"type": "long"}}}}


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "root"))
    s.create_index("books", BODY)
    return s


def ids(store, body=None, pit=None):
    return sorted(h["_id"] for h in store.search("books", body or {}, pit).response()["hits"])


def lines(*items) -> str:
    return "\n".join(json.dumps(x) for x in items) + "\n"


def test_bulk_order_and_outcomes(store, tmp_path):
    body = lines({"index": {"_index": "books", "_id": "doc-1"}}, {"pages": 1}, {"create": {"_id": "doc-2"}}, {"pages": 2}, {"index": {}}, {"pages": 3}, {"delete": {"_id": "doc-1"}}, {"delete": {}}, {"create": {"_id": "d", "routing": "r"}}, {"delete": {"x": 1}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text(body)
    out = store.bulk(str(tmp_path / "in"), "books")["books"].collect()
    assert [(r["op"], r["status"]) for r in out] == [("index", 200), ("create", 201), ("index", 200), ("delete", 200), ("delete", 400), ("create", 201)]
    auto = out[2]["_id"]
    rows = {r["_id"]: r for r in store.index("books").docs.collect()}
    assert rows.keys() == {"doc-2", auto, "d"} and rows[auto]["_shard"] == zlib.crc32(auto.encode()) % 3 and rows["d"]["_shard"] == zlib.crc32(b"r") % 3 == store.route("books", "d", "r")
    again = store.bulk([lines({"create": {"_id": "doc-2"}}, {"pages": 9}, {"create": {"_id": "n"}}, {"title": "first"}, {"delete": {"_id": "n"}}, {"create": {"_id": "n"}}, {"title": "second"})], "books")["books"].collect()
    assert [r["status"] for r in again] == [409, 201, 200, 201]
    docs = {h["_id"]: h["_source"] for h in store.search("books", {}).response()["hits"]}
    assert docs["n"] == {"title": "second"} and docs["doc-2"] == {"pages": 2}


def test_single_writes(store):
    assert store.put("books", {"title": "Searching in Action", "pages": 300}, "1")["result"] == "indexed"
    assert store.put("books", {"pages": 1}, "2", create=True)["result"] == "created"
    with pytest.raises(Conflict):
        store.put("books", {"pages": 2}, "2", create=True)
    assert store.delete("books", "absent")["result"] == "deleted"
    store.put("books", {"title": "again"}, "1", routing="elsewhere")
    assert len(ids(store)) in (2, 3)  # an id is unique within its shard
    assert ids(store, {"query": {"match": {"title": "SEARCHING"}}}) in (["1"], [])
    with pytest.raises(RequestError):
        store.put("books", "[1]", "3")


def test_by_query_pit_and_maintenance(store):
    store.bulk([lines(*[x for i in range(6) for x in ({"index": {"_id": f"d{i}"}}, {"pages": i, "category": "ab"[i % 2]})])], "books")
    pit = store.open_pit("books", "1h")
    assert store.update_by_query("books", {"query": {"range": {"pages": {"gte": 4}}}, "doc": {"category": "c", "new": [1]}}) == "updated=2"
    assert store.update_by_query("books", {"query": {"term": {"category": "none"}}, "doc": {"x": 1}}) == "updated=0"
    assert store.search("books", {"query": {"term": {"category": "c"}}, "sort": ["pages"]}).response()["hits"][0]["_source"] == {"pages": 4, "category": "c", "new": [1]}
    assert store.delete_by_query("books", {"query": {"term": {"category": "a"}}}) == "deleted=2"
    assert ids(store) == ["d1", "d3", "d4", "d5"] and ids(store, pit=pit) == [f"d{i}" for i in range(6)]
    m = store.compact("books")
    assert len(m.base) == 1 and not m.deltas and store.compact("books") == m
    assert store.collect_garbage("books") and ids(store, pit=pit) == [f"d{i}" for i in range(6)] and ids(store) == ["d1", "d3", "d4", "d5"]
    store.close_pit("books", pit)
    with pytest.raises(NotFound):
        ids(store, pit=pit)
    store.collect_garbage("books")
    assert len(store.generations("books")) == 1 and ids(store) == ["d1", "d3", "d4", "d5"]
    assert store.delete_by_query("books") == "deleted=4" and ids(store) == []
    with pytest.raises(RequestError):
        store.update_by_query("books", {"doc": {}})
    old = store.open_pit("books", 0)
    with pytest.raises(NotFound):
        ids(store, pit=old)


def test_catalog(store):
    with pytest.raises(Conflict):
        store.create_index("books")
    with pytest.raises(RequestError):
        store.create_index("other", {"settings": {"number_of_replicas": 1}})
    with pytest.raises(RequestError):
        store.create_index("other", {"settings": {"shards": 0}, "mappings": {}}, shards=0)
    store.put("books", {"pages": 5}, "1")
    store.put_mapping("books", {"properties": {"tags": {"type": "keyword", "multi_valued": True}}})
    with pytest.raises(Conflict):
        store.put_mapping("books", {"properties": {"pages": {"type": "keyword"}}})
    store.put("books", {"tags": ["x"]}, "2")
    assert ids(store, {"query": {"term": {"tags": "x"}}}) == ["2"] and ids(store) == ["1", "2"]
    assert store.status().collect()[0]["index"] == "books" and {r["docs"] for r in store.shard_counts("books").collect()} <= {1, 2}
    assert ids(store, {"routing": "1"}) in (["1"], ["1", "2"])
    store.delete_index("books")
    with pytest.raises(NotFound):
        store.settings("books")
    store.create_index("books", {"lifecycle": {"phases": {"warm": {"min_age": "1d"}, "delete": {"min_age": "30d"}}}})
    made = store.settings("books")["created_at"] / 1000
    assert store.maintain("books", made + 10) is None and store.maintain("books", made + 2 * 86400) == "warm" and store.maintain("books", made + 31 * 86400) == "delete"
    assert store.indices() == []


def test_a_lost_race_is_a_conflict(store):
    before = store.manifest("books")
    store.put("books", {"pages": 1}, "1")
    with pytest.raises(Conflict):
        store._publish("books", before, (), (), 1)


def test_stream(store, spark, tmp_path):
    folder = tmp_path / "stream"
    spark.createDataFrame([("a", '{"pages": 1}', 0), ("a", '{"pages": 2}', 1), ("b", '{"pages": 3}', 0)], "id string, source string, seq long").write.parquet(str(folder))
    read = lambda: spark.readStream.schema("id string, source string, seq long").parquet(str(folder))
    upserts(read(), store, "books", str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("b", '{"pages": 4}', 0)], "id string, source string, seq long").write.mode("append").parquet(str(folder))
    upserts(read(), store, "books", str(tmp_path / "check")).awaitTermination()
    assert {h["_id"]: h["_source"]["pages"] for h in store.search("books", {}).response()["hits"]} == {"a": 2, "b": 4}


def test_point_in_time_query_asks_for_every_order(spark, monkeypatch):
    from docmill import queries

    SF = "/root/testdata/sf0.001"
    sizes, search = [], Store.search
    monkeypatch.setattr(Store, "search", lambda self, name, body, *more: sizes.append(body["size"]) or search(self, name, body, *more))
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert queries.q_point_in_time(spark, SF).count() == n and sizes == [n]


def test_bulk_refuses_before_it_writes(store):
    good = lines({"index": {"_index": "books", "_id": "1"}}, {"pages": 1})
    with pytest.raises(RequestError):
        store.bulk([good, lines({"index": {"_id": "2"}}, {"pages": 2})])
    with pytest.raises(NotFound):
        store.bulk([good + lines({"index": {"_index": "nowhere", "_id": "2"}}, {"pages": 2})])
    assert store.manifest("books").generation == 0


def test_bulk_blank_lines(store):
    one, two = lines({"index": {"_id": "1"}}, {"pages": 1}), lines({"delete": {"_id": "9"}}, {"index": {"_id": "2"}}, {"pages": 2})
    out = store.bulk([f"\n{one}\n  \n{two}\n\n"], "books")["books"].collect()
    assert [(r["op"], r["_id"], r["status"]) for r in out] == [("index", "1", 200), ("delete", "9", 200), ("index", "2", 200)]
    torn = store.bulk([lines({"index": {"_id": "3"}}) + "\n" + lines({"pages": 3}), one], "books")["books"].collect()
    assert {r["status"] for r in torn} == {400, 200} and ids(store) == ["1", "2"]


def test_garbage_spares_outcomes_and_writers(store, spark):
    out = store.apply("books", spark.createDataFrame([("index", "1", None, '{"pages": 1}', 0, None)], "op string, id string, routing string, source string, _seq long, _error string"))
    delta = store._put("books", store.index("books").docs.withColumn("_op", F.lit("index")))  # a writer that has not published yet
    store.collect_garbage("books")
    assert out.count() == 1
    before = store.manifest("books")
    store._publish("books", before, before.base, (*before.deltas, delta), before.seq + 1)
    assert ids(store) == ["1"]
    left = store.files.names(f"{store.root}/books/data")
    store.collect_garbage("books", spared=0)
    assert len(store.files.names(f"{store.root}/books/data")) < len(left) and ids(store) == ["1"]


def test_two_writers(store, spark, monkeypatch):
    """A commit that comes between another's reading and its publishing makes that one try again; both are kept."""
    publish, raced = Store._publish, []

    def between(self, name, before, *more):
        if not raced:
            raced.append(True)
            Store(spark, store.root).put("books", {"pages": 2}, "other")
        return publish(self, name, before, *more)

    monkeypatch.setattr(Store, "_publish", between)
    store.put("books", {"pages": 1}, "mine")
    assert ids(store) == ["mine", "other"] and store.generations("books") == [1, 2]


def test_a_manifest_in_writing_is_not_read(store, monkeypatch):
    store.put("books", {"pages": 1}, "1")
    store.files.create(f"{store.root}/books/generations/gen-{2:010d}.json", '{"generation": 2, "ba')
    assert store.manifest("books").generation == 1 and ids(store) == ["1"]
    with pytest.raises(Conflict):
        store.put("books", {"pages": 1}, "2")
    monkeypatch.setattr("docmill.sources.store.TORN", -1)  # its writer is dead
    store.put("books", {"pages": 1}, "2")
    assert ids(store) == ["1", "2"]


def test_a_replayed_batch_is_written_once(store, spark):
    ops = spark.createDataFrame([("index", None, None, '{"pages": 1}', 0, None)], "op string, id string, routing string, source string, _seq long, _error string")
    assert store.apply("books", ops, ("s", 0)).count() == 1 and store.apply("books", ops, ("s", 0)) is None
    store.compact("books")
    assert store.apply("books", ops, ("s", 0)) is None and store.apply("books", ops, ("s", 1)).count() == 1 and store.apply("books", ops, ("t", 0)).count() == 1
    assert len(ids(store)) == 3


def test_lifecycle_policies_by_name(store):
    with pytest.raises(NotFound):
        store.attach_lifecycle_policy("books", "month")
    with pytest.raises(RequestError):
        store.put_lifecycle_policy("month", {"phases": {"tepid": {}}})
    store.put_lifecycle_policy("month", {"phases": {"warm": {"min_age": "1d"}, "delete": {"min_age": "30d"}}})
    store.attach_lifecycle_policy("books", "month")
    made = store.settings("books")["created_at"] / 1000
    assert store.maintain("books", made + 2 * 86400) == "warm" and store.indices() == ["books"]
    assert store.maintain("books", made + 31 * 86400) == "delete" and store.indices() == []
    store.delete_lifecycle_policy("month")
    with pytest.raises(NotFound):
        store.lifecycle_policy("month")


def test_a_point_in_time_belongs_to_its_index(store):
    store.create_index("other", BODY)
    pit = store.open_pit("books")
    with pytest.raises(RequestError):
        store.search("other", {}, pit)


def test_scores_by_shard(store):
    docs = {f"d{i}": {"title": "red " * (1 + i % 3) + "blue"} for i in range(12)}
    store.bulk([lines(*[x for k, v in docs.items() for x in ({"index": {"_id": k}}, v)])], "books")
    body = {"query": {"match": {"title": "red"}}, "size": 20}
    whole = {h["_id"]: h["_score"] for h in store.search("books", body).response()["hits"]}
    own = {h["_id"]: h["_score"] for h in store.search("books", {**body, "stats": "shard"}).response()["hits"]}
    assert whole.keys() == own.keys() == docs.keys() and whole != own
    index = store.index("books")
    for shard in range(3):
        alone = replace(index, docs=index.docs.where(F.col("_shard") == shard), shards=1)
        for h in search(alone, body).response()["hits"]:
            assert own[h["_id"]] == pytest.approx(h["_score"])


def test_metrics_are_one_pass(store):
    store.bulk([lines(*[x for i in range(5) for x in ({"index": {"_id": f"d{i}"}}, {"pages": i, "title": "t"})])], "books")
    found = store.search("books", {"aggs": {"a": {"min": {"field": "pages"}}, "b": {"max": {"field": "pages"}}, "c": {"range": {"field": "pages", "ranges": [{"to": 2}]}}}, "sort": [{"pages": "desc"}]})
    assert all("parquet" not in d._jdf.queryExecution().toString().lower() for d in found.aggregations.values())
    out = found.response()
    assert (out["aggregations"]["a"]["value"], out["aggregations"]["b"]["value"], out["aggregations"]["c"]["buckets"][0]["doc_count"]) == (0, 4, 2)
    assert [h["sort_values"] for h in out["hits"]] == [[4], [3], [2], [1], [0]]


def test_writers_merge_many_deltas(spark, tmp_path):
    store = Store(spark, str(tmp_path / "small"), compact_after=3)
    store.create_index("books", BODY)
    pit = None
    for i in range(5):
        store.put("books", {"pages": i}, f"d{i % 4}")
        pit = pit or store.open_pit("books")
    m = store.manifest("books")
    assert len(m.base) == 1 and len(m.deltas) < 3 and ids(store) == ["d0", "d1", "d2", "d3"] and ids(store, pit=pit) == ["d0"]
    assert {h["_id"]: h["_source"]["pages"] for h in store.search("books", {"read_preference": "weak"}).response()["hits"]}["d0"] == 4
    rows = {r["generation"]: r for r in store.snapshot_status("books").collect()}
    assert rows[1]["pins"] == 1 and sum(r["pins"] for r in rows.values()) == 1 and rows[m.generation]["base"] == list(m.base)
    with pytest.raises(RequestError):
        store.search("books", {"read_preference": "none"})


def test_bulk_lines_over_blocks_and_chunks(spark, tmp_path, monkeypatch):
    """One file is read by several tasks, and its lines' roles follow from all lines before, wherever chunks end."""
    import random

    from docmill.sources import bulk

    def naive(body: str) -> list[tuple]:
        dense, out = [(i, x) for i, x in enumerate(x.removesuffix("\r") for x in body.split("\n")) if x.strip(" ")], []
        document = False
        for (i, x), (j, y) in zip(dense, [*dense[1:], (None, None)]):
            deletes = x.startswith('{"delete"')
            if not document:
                op = next((n for n in ("index", "create", "delete") if x.startswith(f'{{"{n}"')), None)
                out.append((i, op, y if op in ("index", "create") else None, not deletes and j is not None and j - i > 1))
            document = not document and not deletes
        return out

    monkeypatch.setattr(bulk, "CHUNK_BITS", 1)
    for seed, deletes in enumerate((0, 0.05, 0.3)):
        r, bodies, at = random.Random(seed), {}, tmp_path / f"{seed}"
        at.mkdir()
        for f in "abc":
            kinds = ['{"delete": {"_id": "%d"}}' if r.random() < deletes else r.choice(('{"index": {"_id": "%d"}}', '{"create": {"_id": "%d"}}', '{"n": %d}', '{"n": %d}\r')) for _ in range(150)]
            bodies[f] = "".join(k % i + "\n" * r.choice((1, 1, 1, 1, 2, 5)) for i, k in enumerate(kinds))
            (at / f).write_bytes(bodies[f].encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            bulk.lines(spark, str(at)).write.parquet(f"{at}-lines")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        rows = spark.read.parquet(f"{at}-lines")
        assert rows.where("file LIKE '%/a'").select("block").distinct().count() > 2
        chunks = bulk.in_chunks(rows)
        got = bulk.items(chunks, bulk.carried(chunks), "books").orderBy("file", "item").collect()
        for f, body in bodies.items():
            assert [(g["item"], g["op"], g["source"], g["torn"]) for g in got if g["file"].endswith(f"/{f}")] == naive(body)


def test_the_first_commit_is_the_base_and_one_delta_is_not_sorted(store, spark):
    from docmill.operators.write import latest

    store.bulk([lines({"index": {"_id": "1"}}, {"pages": 1}, {"delete": {"_id": "2"}}, {"create": {"_id": "1"}}, {"pages": 2}, {"create": {"_id": "3"}}, {"pages": 3}, {"delete": {"_id": "3"}})], "books")
    assert ids(store) == ["1"] and len(store.manifest("books").base) == 1 and not store.manifest("books").deltas
    out = store.bulk([lines({"create": {"_id": "1"}}, {"pages": 4}, {"delete": {"_id": "1"}}, {"create": {"_id": "1"}}, {"pages": 5}, {"index": {"_id": "4"}}, {"pages": 6})], "books")["books"]
    assert [r["status"] for r in out.collect()] == [409, 200, 201, 200]
    docs = store.index("books").docs
    assert {r["_id"]: r["pages"] for r in docs.collect()} == {"1": 5, "4": 6} and len(store.manifest("books").deltas) == 1
    assert "Window" not in docs._jdf.queryExecution().executedPlan().toString()
    # of several deltas no piece of a file is sorted as a whole: nothing is before the shuffle
    plan = latest(spark.read.parquet(*store.manifest("books").deltas))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan[plan.index("Exchange") :]
