"""From raw documents to token ids: five of the corpus operators in a row.

Each stage's result is written as Parquet and read again by the next. All
stages but the last return the columns of their documents, whatever the other
columns' names: they are carried as one and never used. Null and empty texts
stay in every stage (null becomes empty where a stage rewrites the text) and
end without ids. Repeated rows are copies: one stays. Texts of any length are
taken whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, near_dup, pieces, queries, repeats, toxicity
from tidewire.llm.common import materialize


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text beside all other columns as one, so that no column can clash with a result."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select((F.struct(*rest) if rest else F.lit(None)).alias("__row"), "doc_id", "text")


def _whole(out: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The carried rows as columns of ``docs`` again; ``changed``: with n_chars of the text of ``out``."""
    now = {"doc_id": F.col("doc_id"), "text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if changed else {})
    return out.select(*[now[c].alias(c) if c in now else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go. Rows without text stay, as any without hits."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _whole(toxicity.score(_carried(docs), docs, labels).filter("predicted = 0"), docs)


#: Words of a shingle in the near-duplicate stage; the query op4_near_duplicates takes two.
SHINGLE = 5


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id. All rows without words stay."""
    judged = near_dup.near_duplicates(docs, SHINGLE).select("doc_id", "text_key", "first", (F.col("n_shingles") > 0).alias("words"))
    judged = materialize(judged, "judged")
    keys = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = judged.filter("first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__other"), F.col("words").alias("__words"))
    counts = judged.agg(F.count("*").alias("rows"), F.count_distinct(F.struct("doc_id", "text_key")).alias("different")).first()
    repeated = counts["rows"] > counts["different"]
    left = _carried(docs).withColumns({"__key": keys, "__rid": F.monotonically_increasing_id()})
    kept = kept.distinct() if repeated else kept
    left = left.join(kept, left["doc_id"].eqNullSafe(kept["__id"]) & (left["__key"] == kept["__other"]))
    if repeated:
        # Rows that are repeated with id and text: one of them stays, but all without words.
        left = left.withColumn("__own", F.when(~F.col("__words"), F.col("__rid"))).dropDuplicates(["doc_id", "__key", "__own"])
    return _whole(left, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur more than once go; every document stays, with the text that is left (empty for null)."""
    return _whole(repeats.Repeats(_carried(docs)).removed(text_to="text"), docs, True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items beyond the coverage limit go; passages beyond the length limit are cut out of the others."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _whole(decontaminate.decontaminate(_carried(docs), benchmark, text_to="text").filter("not contaminated"), docs, True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    proto = pieces.read_model(f"{queries.TOKENIZERS}/{queries.PIECE_MODEL}")
    out = pieces.decode(pieces.encode(docs.select("doc_id", "text"), proto), proto)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "score", (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
#: Automata, signatures and suffix arrays have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
