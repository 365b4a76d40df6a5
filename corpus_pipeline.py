"""A corpus pipeline of five stages; each reads what the one before wrote.

1. toxicity: documents that the weakly supervised classifier rejects go.
2. n-gram Jaccard join (five words, similarity 0.8): of each group of near duplicates one document stays, that
   with the smallest doc_id; documents without words stay.
3. personal data: the spans found are replaced by their kind.
4. mixing: sources are repeated or thinned out to their target weights, in training order.
5. SentencePiece: the ids of every document.

The models of stages 1 and 3 are fitted on the stage's own input; labels come from the ``labels`` table. The
rows of the result are in no particular order; ``position`` counts from the mix. Nulls, empty texts,
repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from featlens.llm import jaccard, mix, pii, piecewise, toxicity
from featlens.llm.common import table
from featlens.llm.queries import PIECES, vocabulary
from featlens.session import ensure_checkpoint_dir, owned_tables

#: SQL cannot fit the stages' models.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piecewise.encode(docs, piecewise.load(vocabulary(PIECES)))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("personal_data", redact_personal_data),
          ("mix", mix_sources), ("pieces", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``: doc_id and ids of every document of the mix."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with owned_tables(spark):  # what a stage writes on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
