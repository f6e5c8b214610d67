"""From raw documents to token ids.  Each stage calls one operator of ``sigloom.llm`` on all that the one before kept.

1. quality: documents that the quality model rejects go.
2. toxicity: documents that the lexicon rejects go.
3. dedup: of each component of near copies (sets of 5-word shingles with a similarity of 0.8 or more) one document stays.
4. mixture: sources are mixed to their target weights; a document sent twice is there twice.
5. tokens: what is left is encoded; one row of ids per document.

The models of the first two stages are learned, as the queries op8 and op2 learn them, from labelled rows of the raw
tables in ``sf_dir``.  All stages read whole texts of any length, keep whatever columns documents have, and give an
empty table for an empty one; what each does with nulls and repeats is said at the stage.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import mixing, pieces, quality, queries, simhash, toxicity
from sigloom.llm.common import remove, shared_folder, ship, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more: null and empty texts as the model judges a text without words, rows
    with a null id and repeated rows like others."""
    ship(spark)
    model = queries.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(model, "text") >= 0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3: null and empty texts have no hit, rows with a null id and repeated rows are
    judged like others."""
    ship(spark)
    lexicon = queries.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(lexicon, "text")["score"] < 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id (null last) of each component of near copies, met by multi-index hashing of fingerprints
    and linked by their sets: null and wordless texts are one component, of repeated rows one stays."""
    ship(spark)
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix sends, as often as it sends them: those without words by their place in their source's order, null
    sources are one source, exact repeats are sent together."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and exact of each document, one row a row: null ids for a null text, none for an empty one."""
    ship(spark)
    return pieces.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("dedup", drop_copies),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: Trained models, fingerprints and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each but the last is written as Parquet to the shared checkpoint folder and read
    again.  A stage's table goes when the next one is written; the last one stays for the result, which reads it."""
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
