"""The corpus pipeline: toxicity, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Models learn from rows of the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import jaccard, langid, mixing, packing, toxicity
from gleaner.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; learned from all labels of kept rows.

    Null and empty texts score as clean, repeated rows alike; without labels of both kinds, or rows, all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    found = toxicity.score(docs, model, *COLUMNS, spans=False)
    return found.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


#: The language stage rejects a document that is in none of the learned languages with at least this calibrated probability.
FOREIGN = 0.9


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the stage's labelled rows teach.

    Those that the model calls ``und`` with a score of ``FOREIGN`` or more go, as do those without a letter.
    Texts of few letters say too little and stay; where no language is labelled nothing is learned and all stay.
    """
    model = langid.fit(docs, F.col("lang") != langid.UNDETERMINED, open_set=True)
    if not model.langs:
        return docs.select(*COLUMNS)
    found = langid.predict(docs, model, *COLUMNS)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    foreign = (F.col("score") == 0) | (F.col("score") >= FOREIGN) & (letters >= langid.FEW_LETTERS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) | ~foreign).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of five-word shingles: that of smallest doc_id.

    Rows without a doc_id are in groups like all others and stay only where a group has no row with one; of several rows
    that could stay (a doc_id repeated, or missing) one does. Null and empty texts are near no other and stay; an empty
    table gives no rows.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS), 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document once for each epoch that takes it whole, and its taken words at the cut.

    Documents without words weigh nothing and are left out; rows repeated are dealt each for itself; an empty table
    gives no rows.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.n_words(F.col("text")))
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.expr("cast(taken div size as int)")).otherwise(0)
    rest = F.when(size > 0, taken % size).otherwise(0)
    copies = mixed.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_n", F.col("_whole") + (F.col("_rest") > 0).cast("int"))
    rows = copies.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    # Only the row at its source's cut is taken in part: its first words, joined by blanks.
    cut = F.when(F.col("_k") > F.col("_whole"), first_words(F.col("row.text"), F.col("_rest"))).otherwise(F.col("row.text"))
    out = rows.select("row.*", cut.alias("_text"))
    return out.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(F.col("text").isNotNull(), F.length("_text").cast("long")).alias("n_chars"))


def first_words(text, n):
    """The first ``n`` words of ``text``, joined by blanks."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({mixing.WORD})"), 1), 1, n.cast("int")), " ")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in windows of 1024 ids; a null text is its end id alone."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained models and tokenizers are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as a table and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
