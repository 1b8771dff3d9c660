"""Queries of the training-data operators, one ``opN_<name>`` each, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lodestrata.llm.bpe import round_trip
from lodestrata.llm import langid, pii
from lodestrata.llm.mixing import mixture_report
from lodestrata.llm.mtree import top_k
from lodestrata.llm.shared import table
from lodestrata.llm.simhash import simhash_groups
from lodestrata.llm.spherical import embedding_groups
from lodestrata.llm.substrings import remove_repeats
from lodestrata.llm.toxicity import grade_documents, train
from lodestrata.llm.warc import write_and_read_back

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@query(
    "op1_warc_capture_index",
    """with p as (select page_id, coalesce(html, '') as body from pages),
       d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p),
       f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
       select page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
        case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
        case when first <> page_id then first end as refers_to
       from d left join f on f.payload_digest = d.payload_digest""",
)
def op1(spark, sf_dir):
    """Every page written to WARC archives, found through the capture index and read back."""
    return write_and_read_back(table(spark, sf_dir, "pages"))


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    """Near-duplicate classes of every document by 3-word SimHash within 2 bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query("op3_toxicity_ordinal")
def op3(spark, sf_dir):
    """Expected severity and grade of every document, by the model fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade_documents(docs, model).select("doc_id", "severity", "grade", (F.col("grade") > 0).alias("rejected"))


@query(
    "op4_mtree_top_k",
    """with t as (select *, row_number() over () as u from embeddings),
       e as (select u, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from t
        where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
       s as (select q.u, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
        from e q join e c on q.vec_id % 20 = 0 and q.u <> c.u),
       r as (select *, row_number() over (partition by u order by score desc, vec_id) as rank from s)
       select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
)
def op4(spark, sf_dir):
    """The 20 highest integer inner products of every query row against all rows."""
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


@query("op5_low_discrepancy_mix")
def op5(spark, sf_dir):
    """Words that the mix takes from every document, beside its source's size and target."""
    return mixture_report(table(spark, sf_dir, "documents"))


@query(
    "op6_spherical_kmeans_dedup",
    """with recursive e as (select vec_id, label, cast(embedding as double[]) as v from embeddings
        where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0),
       l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
        where list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.98),
       r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.b from r join l on l.a = r.y),
       c as (select x, min(y) as component_id from r group by x),
       n as (select a, count(*) as n from l group by a)
       select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
       from embeddings v join c on c.x = v.vec_id left join n on n.a = v.vec_id""",
)
def op6(spark, sf_dir):
    """Near-duplicate classes of every embedding within its label at cosine 0.98."""
    return embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    """Ids of every whole text under the 50k rank file, digested, and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_repeated_phrase_automata")
def op8(spark, sf_dir):
    """Every whole text without the words of 20-word windows that occurred earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


@query("op9_byte_cnn_language")
def op9(spark, sf_dir):
    """Predicted language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.train(docs))


@query("op10_pii_boosted")
def op10(spark, sf_dir):
    """Personal data in every whole text: base spans, and those the boosted trees add."""
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train_on(docs))


@query("pipeline")
def pipeline(spark, sf_dir):
    """The five stages of ``corpus_pipeline`` over every document."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
