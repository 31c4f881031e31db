"""Documents to training data in five stages, each one operator over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, whatever else these hold and however it is named:
a stage works on numbered names and gives every column that it doesn't decide on back as it came. Empty tables pass
through every stage; texts of any length are read whole; rows that repeat are rows of their own unless they are near
duplicates.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, language_id, pii, simhash
from docmill.llm._util import dropped, merged, table, written

#: Tables of ids of so many rows at most are broadcast, counted and not by what Spark takes for their size; larger ones are joined by sorting.
FEW = 1000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by place, and these names by the old ones."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def _named(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df's numbered columns under docs' names, others gone."""
    return df.select(*[f"__{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _ids(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else merged(df)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is null, empty or without a letter; a missing lang becomes the predicted one, or stays null if no document tells of a language. A lang that is there is kept, equal losses go to the language first by name."""
    d, at = _numbered(docs)
    lang, text = at["lang"], at["text"]
    model = language_id.train(d, lang, text)
    if not model.languages:
        return _named(d.where(F.col(text).rlike(r"\p{L}")), docs)
    told = language_id.predict(d, model, text).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return _named(told.withColumn(lang, F.coalesce(lang, "lang_pred")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates; if rows share that id, the one of least text, and of these the one whose columns are least as JSON. Null and wordless texts are one group; a null id comes after every other."""
    d, at = _numbered(docs)
    key, text = at["doc_id"], at["text"]
    groups = written(simhash.near_duplicates(d, key, text).withColumnRenamed(key, "__id"), "groups")
    gone = groups.where(~F.col("__id").eqNullSafe(F.col("component_id"))).select("__id")
    many = written(groups.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"), "many")
    n_gone, n_many = gone.count(), many.count()
    if not n_many:
        return _named(d.join(_ids(gone, n_gone), d[key].eqNullSafe(gone["__id"]), "left_anti"), docs)
    # an id that several rows share tells nothing of a row: these find their group by fingerprint
    gone = _ids(gone.unionAll(many).distinct(), n_gone + n_many)
    shared = simhash.fingerprints(d.join(_ids(many, n_many), d[key].eqNullSafe(many["__id"]), "left_semi"), text)
    first = groups.where(F.col("__id").eqNullSafe(F.col("component_id"))).select("__id", "fingerprint", "group").distinct()
    found = shared.join(merged(first), shared[key].eqNullSafe(first["__id"]) & (F.lower(F.lpad(F.hex("fp"), 16, "0")) == first["fingerprint"]))
    order = Window.partitionBy("group").orderBy(F.col(text).asc_nulls_last(), F.to_json(F.struct(*[found[c] for c in d.columns])))
    best = found.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(*d.columns)
    return _named(d.join(gone, d[key].eqNullSafe(gone["__id"]), "left_anti").unionByName(best), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. A null or wordless text holds none and stays; an empty benchmark drops nothing."""
    d, at = _numbered(docs)
    return _named(decontaminate.contamination(d, table(spark, sf_dir, "benchmark"), text=at["text"]).where("NOT contaminated"), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in text by its kind, and n_chars, where there is one, by the new text's length. A null text stays null, with a null n_chars; no row goes."""
    d, at = _numbered(docs)
    masked = pii.mask(d, at["text"])
    if n_chars := at.get("n_chars"):
        masked = masked.withColumn(n_chars, F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return _named(masked, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of text, their number and the hashes of ids and of the bytes decoded from them. A null text is an empty one, of no ids; equal texts get equal ids; other columns end here."""
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path("byte_bpe_50k.tiktoken"), ids=True).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("encode", encode),
]

#: The codes' weights of the first stage are learnt, which SQL cannot express: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
