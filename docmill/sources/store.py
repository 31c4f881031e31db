"""Tables of documents on a file system: a catalog of indices, and for each index numbered generations.

A generation is a manifest: a JSON file that lists immutable folders of Parquet files, some of the base and some of
deltas. Writers put their files down first and then create the next manifest, which fails if it exists: so readers see
whole commits, and of two writers one has to try again. A manifest that doesn't parse is still being written and counts
for nothing; its writer having died, another removes it after a while. Files of a task that failed or of a writer that
lost are in no manifest and are collected as garbage, once they are old enough that no writer can still publish them.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import mapping as M
from docmill.errors import Conflict, NotFound, RequestError
from docmill.functions.values import to_millis
from docmill.operators.search import Found, knn_search, matching, search
from docmill.operators.write import KEY, latest, merged, outcomes
from docmill.plans.index import Index, of_sources, shard
from docmill.sources import bulk as bulk_source
from docmill.sources.files import Files

PHASES = ("hot", "warm", "cold", "frozen", "delete")
#: Seconds after which a manifest that doesn't parse is taken for a dead writer's.
TORN = 60


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    base: tuple[str, ...] = ()
    deltas: tuple[str, ...] = ()
    seq: int = 0
    #: The last batch of each stream that is in it.
    batches: Mapping[str, int] = field(default_factory=dict)

    @staticmethod
    def of(text: str | None) -> Manifest | None:
        """The manifest of a file's text; None of what isn't written to its end."""
        try:
            m = json.loads(text or "")
        except ValueError:
            return None
        return Manifest(m["generation"], tuple(m["base"]), tuple(m["deltas"]), m["seq"], m.get("batches", {}))


class Store:
    """Indices under one root folder. A writer that brings an index to compact_after deltas merges them, so that a read
    never has more to put together."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 16):
        self.spark, self.root, self.files, self.compact_after = spark, root.rstrip("/"), Files(spark), compact_after

    # -- catalog

    def create_index(self, name: str, body: Mapping | None = None, shards: int | None = None) -> dict:
        """A new index with the body's mappings, numberOfShards and lifecycle; replicas other than 0 are refused."""
        body = body or {}
        if not name or name[0] in "_." or "/" in name:
            raise RequestError(f"no index can be called {name!r}")
        settings = body.get("settings") if isinstance(body.get("settings"), Mapping) else {}
        pick = lambda *ks: next((s[k] for s in (settings, body) for k in ks if k in s), None)
        if pick("number_of_replicas", "numberOfReplicas", "replicas"):
            raise RequestError("replicas are not supported: the number is 0")
        n = shards if shards is not None else pick("number_of_shards", "numberOfShards", "shards") or 1
        if n <= 0:
            raise RequestError("an index has one shard at least")
        made = {"name": name, "shards": int(n), "created_at": round(time.time() * 1000), "lifecycle": body.get("lifecycle") or body.get("lifecyclePolicy") or pick("lifecycle_policy", "lifecyclePolicy") or {}, "mappings": {k: asdict(m) for k, m in M.parse(body).items()}}
        self.files.create(f"{self.root}/{name}/index.json", json.dumps(made))
        return made

    def settings(self, name: str) -> dict:
        text = self.files.read(f"{self.root}/{name}/index.json")
        if text is None or json.loads(text).get("deleting"):
            raise NotFound(f"no index is called {name}")
        return json.loads(text)

    def indices(self) -> list[str]:
        return [n for n in self.files.names(self.root) if (t := self.files.read(f"{self.root}/{n}/index.json")) and not json.loads(t).get("deleting")]

    def delete_index(self, name: str) -> None:
        """Mark the index as gone, then drop its data, then the mark."""
        self.files.replace(f"{self.root}/{name}/index.json", json.dumps({**self.settings(name), "deleting": True}))
        for part in ("data", "generations", "pins"):
            self.files.remove(f"{self.root}/{name}/{part}")
        self.files.remove(f"{self.root}/{name}")

    def mappings(self, name: str) -> dict[str, M.FieldMapping]:
        return {k: M.FieldMapping(**m) for k, m in self.settings(name)["mappings"].items()}

    def put_mapping(self, name: str, body: Mapping) -> dict[str, M.FieldMapping]:
        """Add fields; one that is mapped otherwise is a conflict, one that is mapped the same stays. Rows written before hold null there."""
        both = M.extended(self.mappings(name), M.parse(body))
        self.files.replace(f"{self.root}/{name}/index.json", json.dumps({**self.settings(name), "mappings": {k: asdict(m) for k, m in both.items()}}))
        return both

    # -- generations

    def generations(self, name: str) -> list[int]:
        return [int(f[4:-5]) for f in self.files.names(f"{self.root}/{name}/generations") if f.startswith("gen-") and f.endswith(".json")]

    def manifest(self, name: str, generation: int | None = None) -> Manifest:
        """A generation's manifest, the latest one by default; of an index without any, or of one that is gone, an empty one."""
        found = self.generations(name)
        if generation is not None:
            found = [g for g in found if g == generation]
        for g in sorted(found, reverse=True):
            if m := Manifest.of(self.files.read(f"{self.root}/{name}/generations/gen-{g:010d}.json")):
                return m
        return Manifest(generation or 0)

    def _publish(self, name: str, before: Manifest, base: tuple[str, ...], deltas: tuple[str, ...], seq: int, batch: tuple[str, int] | None = None) -> Manifest:
        made = Manifest(before.generation + 1, base, deltas, seq, {**before.batches, **({batch[0]: batch[1]} if batch else {})})
        path = f"{self.root}/{name}/generations/gen-{made.generation:010d}.json"
        try:
            self.files.create(path, json.dumps(asdict(made)))
        except Conflict:
            if Manifest.of(self.files.read(path)) is None and self.files.age(path) > TORN:
                self.files.remove(path)
            raise
        return made

    def _folder(self, name: str) -> str:
        """A new folder of data; its name begins with the time in milliseconds, by which garbage is told from work."""
        return f"{self.root}/{name}/data/{round(time.time() * 1000):013d}-{uuid.uuid4().hex}"

    def _put(self, name: str, df: DataFrame) -> str:
        path = self._folder(name)
        # files of about the advised size, those of a large shard split, those of small ones not scattered
        df.hint("rebalance", F.col("_shard")).write.partitionBy("_shard").parquet(path)
        return path

    def _read(self, name: str, paths: tuple[str, ...], op: bool) -> DataFrame:
        mappings = self.mappings(name)
        tokens = [f"`_tok_{n}` array<string>" for n, m in mappings.items() if m.type == "text" and m.indexed]
        typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in M.schema(mappings).fields]
        schema = ", ".join(["_id string", "_index string", "_shard int", "_seq long", "_source string", "_field_names array<string>", *typed, *tokens, *(["_op string"] if op else [])])
        if not paths:
            return self.spark.createDataFrame([], schema)
        frames = [self.spark.read.schema(schema).option("basePath", p).parquet(p) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def index(self, name: str, generation: int | None = None) -> Index:
        """The documents of a generation (the latest), as an index to search. One that is gone is empty."""
        m = self.manifest(name, generation)
        base = self._read(name, m.base, False)
        docs = merged(base, self._read(name, m.deltas, True), len(m.deltas) > 1) if m.deltas else base
        return Index(name, self.mappings(name), docs, self.settings(name)["shards"])

    # -- writes

    def apply(self, name: str, ops: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """Write operations (op, id, routing, source, _seq, _error) as one commit; returns each one's outcome, written out
        and kept for as long as garbage is spared.

        A blank id gets a random one. Tries again if another writer commits first. batch names a stream and numbers its
        batches: one that is committed already is not written again, and None comes back.
        """
        settings, mappings = self.settings(name), self.mappings(name)
        if batch and self.manifest(name).batches.get(batch[0], -1) >= batch[1]:
            return None
        named = ops.withColumn("_id", F.coalesce("id", F.concat(F.lit("auto-"), F.expr("uuid()"))))
        key = F.coalesce(F.when(F.trim("routing") != "", F.col("routing")), F.col("_id"))
        placed = named.withColumns({"_index": F.lit(name), "_shard": shard(key, settings["shards"], name), "_source": F.col("source"), "_op": F.col("op")})
        typed = of_sources(placed.select("_id", "_index", "_shard", "_seq", "_source", "_op", F.col("_error").alias("__given")), mappings)
        checked = typed.withColumn("_error", F.coalesce("__given", F.when(F.col("_op") != "delete", F.col("_error")))).drop("__given")
        # random ids must be the same in every pass over them; documents are parsed once
        staged = self._folder(name)
        checked.write.parquet(staged)
        rows = self.spark.read.schema(checked.schema).parquet(staged)
        for attempt in range(5):
            before = self.manifest(name)
            if batch and before.batches.get(batch[0], -1) >= batch[1]:
                return None
            shifted = rows.withColumn("_seq", F.col("_seq") + before.seq)
            judged = outcomes(shifted, self._existing(name, before, shifted))
            # a document's columns are kept where they count only
            kept = ("_seq", "_op", *KEY, "_status", "_result", "_last")
            slim = judged.select(*kept, *[F.when(F.col("_last"), F.col(f"`{c}`")).alias(c) for c in judged.columns if c not in (*kept, "_effective", "_error")])
            written = self._folder(name)
            slim.write.parquet(written)
            done = self.spark.read.schema(slim.schema).parquet(written)
            empty = not (before.base or before.deltas)
            # the first commit hides nothing and is the base
            last = done.where(F.col("_last") & (F.col("_op") != "delete") if empty else F.col("_last")).drop("_status", "_result", "_last", *(["_op"] if empty else []))
            put = self._put(name, last)
            top = rows.agg(F.max("_seq")).first()[0]
            base, deltas = ((put,), ()) if empty else (before.base, (*before.deltas, put))
            try:
                self._publish(name, before, base, deltas, before.seq + (top if top is not None else -1) + 1, batch)
            except Conflict:
                if attempt == 4:
                    raise
                continue
            self._tidy(name)
            return done.select("_seq", F.col("_op").alias("op"), "_id", "_shard", F.col("_status").alias("status"), F.col("_result").alias("result")).orderBy("_seq")
        raise Conflict(f"index {name}: other writers kept committing first")

    def _tidy(self, name: str) -> None:
        """Compact an index of many deltas; a writer that commits meanwhile leaves that to the next."""
        if len(self.manifest(name).deltas) >= self.compact_after:
            try:
                self.compact(name)
            except Conflict:
                pass

    def _existing(self, name: str, at: Manifest, ops: DataFrame) -> DataFrame | None:
        """Keys of documents that a create of ops may meet, None if there are none. Without creates the table is not read; else its keys are cut to theirs, shard by shard."""
        keys = ops.where("_op = 'create' AND _error IS NULL").select(*KEY).distinct()
        if not (at.base or at.deltas) or keys.isEmpty():
            return None
        return self.index(name, at.generation).docs.select(*KEY).join(keys, list(KEY), "left_semi")

    def bulk(self, bodies: list[str] | str, index: str | None = None) -> dict[str, DataFrame]:
        """Apply bulk requests, given as strings or as a path of files; outcomes by index, items in order of file and line.

        An item that names no index, or one that isn't there, refuses the call before anything is written. Each index
        is one commit.
        """
        lines = bulk_source.lines(self.spark, bodies) if isinstance(bodies, str) else bulk_source.of_strings(self.spark, bodies)
        scratch = f"{self.root}/_bulk/{uuid.uuid4().hex}"

        def written(df: DataFrame, part: str) -> DataFrame:
            df.write.parquet(f"{scratch}/{part}")
            return self.spark.read.schema(df.schema).parquet(f"{scratch}/{part}")

        try:
            chunks = written(bulk_source.in_chunks(lines), "chunks")
            found = bulk_source.whole(written(bulk_source.items(chunks, written(bulk_source.carried(chunks), "carry"), index), "items"))
            names = [r[0] for r in found.select("index").distinct().collect()]  # as many as indices named
            if None in names:
                first = found.where("index IS NULL").orderBy("file", "item").first()
                raise RequestError(f"bulk: the item at line {first['item'] + 1} names no index")
            for name in names:
                self.settings(name)
            parts = {name: found.where(F.col("index") == name) for name in sorted(names)}
            return {name: self.apply(name, numbered(part, written(files_in_order(part), f"files-{i}"))) for i, (name, part) in enumerate(parts.items())}
        finally:
            self.files.remove(scratch)

    def put(self, name: str, source: Mapping | str, id: str | None = None, routing: str | None = None, create: bool = False) -> dict:
        """Write one document."""
        text = source if isinstance(source, str) else json.dumps(source)
        rows = [("create" if create else "index", id if id and id.strip() else None, routing, text, 0, None)]
        r = self.apply(name, self.spark.createDataFrame(rows, OPS)).first()
        if r["status"] == 409:
            raise Conflict(r["result"])
        if r["status"] == 400:
            raise RequestError(r["result"])
        return {"_id": r["_id"], "_shard": r["_shard"], "result": r["result"]}

    def delete(self, name: str, id: str, routing: str | None = None) -> dict:
        """Delete one document; it says so even if there was none."""
        r = self.apply(name, self.spark.createDataFrame([("delete", id, routing, None, 0, None)], OPS)).first()
        return {"_id": r["_id"], "_shard": r["_shard"], "result": "deleted"}

    def _commit(self, name: str, before: Manifest, delta: DataFrame) -> int:
        path = self._put(name, delta)
        n = self.spark.read.schema(delta.schema).parquet(path).count()
        if n:
            self._publish(name, before, before.base, (*before.deltas, path), before.seq + 1)
            self._tidy(name)
        return n

    def delete_by_query(self, name: str, body: Mapping | None = None) -> str:
        """Delete what a query matches; without one that is everything."""
        before = self.manifest(name)
        docs, _ = matching(self.index(name, before.generation), (body or {}).get("query"))
        n = self._commit(name, before, docs.withColumns({"_op": F.lit("delete"), "_seq": F.lit(before.seq).cast("long")}))
        return f"deleted={n}"

    def update_by_query(self, name: str, body: Mapping) -> str:
        """Merge body.doc, top-level keys only, into the documents that body.query matches, and derive their columns anew."""
        doc = body.get("doc")
        if not isinstance(doc, Mapping) or not doc:
            raise RequestError("update_by_query needs a doc with keys")
        before = self.manifest(name)
        docs, _ = matching(self.index(name, before.generation), body.get("query"))
        rows = docs.select("_id", "_index", "_shard", F.lit(before.seq).cast("long").alias("_seq"), merge_patch(F.col("_source"), doc).alias("_source"))
        typed = of_sources(rows, self.mappings(name))
        n = self._commit(name, before, typed.where("_error IS NULL").drop("_error").withColumn("_op", F.lit("index")))
        return f"updated={n}"

    # -- reads

    def search(self, name: str, body: Mapping, pit: str | None = None) -> Found:
        return search(self._view(name, body, pit), body)

    def knn_search(self, name: str, body: Mapping, pit: str | None = None) -> Found:
        return knn_search(self._view(name, body, pit), body)

    def _view(self, name: str, body: Mapping, pit: str | None) -> Index:
        """What a body reads. A write returns when its commit is published, so weak and strong reads see the same."""
        preference = body.get("read_preference", body.get("readPreference", "strong"))
        if str(preference).lower() not in ("weak", "strong"):
            raise RequestError(f"read_preference is weak or strong, not {preference!r}")
        inner = body.get("pit")
        pit = pit or (inner.get("id") if isinstance(inner, Mapping) else None) or body.get("pit_id")
        return self.index(name, self._pinned(name, pit) if pit else None)

    def open_pit(self, name: str, keep_alive: object = "1m") -> str:
        """Pin the latest generation for a time; the id that reads it."""
        pit = f"{zlib.crc32(name.encode()):08x}{uuid.uuid4().hex}"
        self.files.create(f"{self.root}/{name}/pins/{pit}.json", json.dumps({"generation": self.manifest(name).generation, "until": round(time.time() * 1000) + to_millis(keep_alive)}))
        return pit

    def _pinned(self, name: str, pit: str) -> int:
        text = self.files.read(f"{self.root}/{name}/pins/{pit}.json")
        if text is None and len(pit) == 40 and pit[:8] != f"{zlib.crc32(name.encode()):08x}":
            raise RequestError(f"point in time {pit} is not one of index {name}")
        if text is None:
            raise NotFound(f"no point in time {pit} of index {name}")
        pin = json.loads(text)
        if pin["until"] < time.time() * 1000:
            raise NotFound(f"point in time {pit} has expired")
        return pin["generation"]

    def close_pit(self, name: str, pit: str) -> None:
        self.files.remove(f"{self.root}/{name}/pins/{pit}.json")

    # -- maintenance

    def compact(self, name: str) -> Manifest:
        """Merge deltas and small files into a new base."""
        before, whole = self.manifest(name), self.index(name)
        if not before.deltas and len(before.base) <= 1:
            return before
        path = self._put(name, whole.docs)
        return self._publish(name, before, (path,), (), before.seq)

    def collect_garbage(self, name: str, keep: int = 1, spared: object = "1h") -> list[str]:
        """Drop all but the last keep generations and those pinned, folders that only dropped ones name, and folders that
        no generation ever named and that are older than spared: until then they may be a writer's, or outcomes that
        someone reads. Returns what was dropped."""
        now, root = time.time() * 1000, f"{self.root}/{name}"
        pins = {}
        for f in self.files.names(f"{root}/pins"):
            pin = json.loads(self.files.read(f"{root}/pins/{f}") or "{}")
            if pin.get("until", 0) < now:
                self.files.remove(f"{root}/pins/{f}")
            else:
                pins[pin["generation"]] = True
        found = self.generations(name)
        kept = set(sorted(found)[-max(1, keep) :]) | {g for g in found if g in pins}
        folders = lambda gs: {p.rsplit("/", 1)[1] for g in gs for m in [self.manifest(name, g)] for p in (*m.base, *m.deltas)}
        used, named, limit = folders(kept), folders(found), now - to_millis(spared)
        gone = []
        for g in found:
            if g not in kept:
                self.files.remove(f"{root}/generations/gen-{g:010d}.json")
                gone.append(f"gen-{g:010d}")
        for part in self.files.names(f"{root}/data"):
            began = part.partition("-")[0]
            if part not in used and (part in named or not began.isdigit() or int(began) < limit):
                self.files.remove(f"{root}/data/{part}")
                gone.append(part)
        return gone

    def maintain(self, name: str, now: float | None = None) -> str | None:
        """Do what the index's lifecycle asks at its age: warm compacts, delete drops the index, the other phases do nothing."""
        settings = self.settings(name)
        age = (now or time.time()) * 1000 - settings["created_at"]
        policy = settings["lifecycle"]
        if isinstance(policy, str):
            policy = self.lifecycle_policy(policy)
        phases = policy.get("phases", policy) if isinstance(policy, Mapping) else {}
        due = None
        for phase in PHASES:
            spec = phases.get(phase)
            after = spec.get("min_age", spec.get("minAge", 0)) if isinstance(spec, Mapping) else spec
            if spec is not None and age >= to_millis(after):
                due = phase
        if due == "warm":
            self.compact(name)
        elif due == "delete":
            self.delete_index(name)
        return due

    def put_lifecycle_policy(self, name: str, body: Mapping) -> dict:
        """A policy by name, made or replaced; indices that it is attached to follow it from then on."""
        if not name or "/" in name:
            raise RequestError(f"no policy can be called {name!r}")
        phases = body.get("phases", body)
        if unknown := set(phases) - set(PHASES):
            raise RequestError(f"policy {name}: no phase is called {sorted(unknown)[0]}")
        for spec in phases.values():
            to_millis(spec.get("min_age", spec.get("minAge", 0)) if isinstance(spec, Mapping) else spec)
        self.files.replace(f"{self.root}/_policies/{name}.json", json.dumps({"phases": phases}))
        return {"name": name, "phases": dict(phases)}

    def lifecycle_policy(self, name: str) -> dict:
        text = self.files.read(f"{self.root}/_policies/{name}.json")
        if text is None:
            raise NotFound(f"no lifecycle policy is called {name}")
        return json.loads(text)

    def delete_lifecycle_policy(self, name: str) -> None:
        """An index that it is attached to then has none to follow, which maintain reports."""
        self.lifecycle_policy(name)
        self.files.remove(f"{self.root}/_policies/{name}.json")

    def attach_lifecycle_policy(self, index: str, policy: str) -> dict:
        self.lifecycle_policy(policy)
        made = {**self.settings(index), "lifecycle": policy}
        self.files.replace(f"{self.root}/{index}/index.json", json.dumps(made))
        return made

    def status(self) -> DataFrame:
        """A row for each index: shards, fields, generations, folders of the base and of deltas."""
        rows = []
        for n in self.indices():
            s, m = self.settings(n), self.manifest(n)
            rows.append((n, s["shards"], len(s["mappings"]), m.generation, len(m.base), len(m.deltas), s["created_at"]))
        return self.spark.createDataFrame(rows, "index string, shards int, fields int, generation long, base int, deltas int, created_at long")

    def snapshot_status(self, name: str) -> DataFrame:
        """A row for each generation that is kept: its folders, the writes it counts, and how many points in time pin it."""
        pins = [json.loads(self.files.read(f"{self.root}/{name}/pins/{f}") or "{}").get("generation") for f in self.files.names(f"{self.root}/{name}/pins")]
        made = [self.manifest(name, g) for g in self.generations(name)]
        rows = [(m.generation, list(m.base), list(m.deltas), m.seq, pins.count(m.generation)) for m in made]
        return self.spark.createDataFrame(rows, "generation long, base array<string>, deltas array<string>, seq long, pins int")

    def route(self, name: str, id: str, routing: str | None = None) -> int:
        """The shard that a document of this id and routing key goes to."""
        key = routing if routing and routing.strip() else id
        return zlib.crc32((key if key.strip() else name).encode()) % self.settings(name)["shards"]

    def shard_counts(self, name: str) -> DataFrame:
        return self.index(name).docs.groupBy("_shard").agg(F.count("*").alias("docs"))


OPS = "op string, id string, routing string, source string, _seq long, _error string"


def files_in_order(items: DataFrame) -> DataFrame:
    """file, __file of each file of items, numbered by name."""
    # as many rows as request bodies
    return items.select("file").distinct().withColumn("__file", F.expr("row_number() OVER (ORDER BY file)") - 1)


def numbered(items: DataFrame, order: DataFrame) -> DataFrame:
    """Bulk items as operations: _seq is the place of a file among the files, then of a line in it."""
    return items.join(order, "file").select("op", "id", "routing", "source", (F.col("__file").cast("long") * (1 << 32) + F.col("item")).alias("_seq"), F.col("error").alias("_error"))


def merge_patch(source, doc: Mapping):
    """A document's JSON with the top-level keys of doc in place of its own."""
    old = F.from_json(source, "map<string,variant>")
    new = F.from_json(F.lit(json.dumps(doc)), "map<string,variant>")
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(doc)))
    return F.to_json(F.map_concat(kept, new))
