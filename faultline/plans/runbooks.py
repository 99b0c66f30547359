"""Runbooks -> chunks -> vectors -> passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.embedding import embedding_column
from faultline.functions.text import chunk_text, utf16_length
from faultline.operators import keyed
from faultline.operators.lookup import service_names, with_service_name
from faultline.operators.search import Vectorize, dense_vectors, text_vectors, vector_topk
from faultline.schemas import CHUNK_CHARACTERS, SEARCH_LIMIT
from faultline.session import lookup_join, materialize, passing, sorted_join, spread


def chunk_runbooks(runbooks: DataFrame, limit: int = CHUNK_CHARACTERS) -> DataFrame:
    """One row per chunk, numbered from 0; nothing for a blank body.

    ``runbooks`` has id, slug, body and service_name, as ``runbook_list`` gives.
    """
    pieces = runbooks.select(
        F.col("id").alias("runbook_id"),
        "slug",
        "service_name",
        F.posexplode(chunk_text(F.col("body"), limit)).alias("chunk_index", "content"),
    )
    return pieces.select(
        F.concat_ws("#", F.col("runbook_id").cast("string"), "chunk_index").alias("id"),
        "runbook_id",
        "chunk_index",
        "content",
        F.struct(
            "slug",
            F.col("service_name").alias("serviceName"),
            utf16_length(F.col("content")).alias("contentLength"),
        ).alias("metadata"),
    )


def content_hash() -> Column:
    return F.unhex(F.sha2("content", 256))


def content_vectors(chunks: DataFrame, stored: DataFrame | None, embed: Callable[[Column], Column]) -> DataFrame:
    """(content_hash, content, embedding) of every distinct content of ``chunks``, written out.

    A content that ``stored`` has a vector for takes it from there; only the others go
    through ``embed``, each once, however many chunks hold it. Texts are shuffled once and
    embedded where they arrive.
    """
    contents = chunks.groupBy("content_hash").agg(F.any_value("content").alias("content"))
    if stored is not None:
        known = stored.where("embedding IS NOT NULL").select(content_hash().alias("content_hash"), "content", "embedding")
        known = sorted_join(known, chunks.select("content_hash"), "content_hash", "left_semi")
        one = F.any_value(F.struct("content", "embedding")).alias("_one")
        known = known.groupBy("content_hash").agg(one).select("content_hash", "_one.*")
        known = materialize(known, "known-vectors", lean=True)
        # An anti join would go below the fold, and the rows of a hot content to one task.
        seen = known.select("content_hash", F.lit(True).alias("_seen"))
        contents = sorted_join(contents, seen, "content_hash", "left").where("_seen IS NULL").drop("_seen")
    fresh = materialize(contents.withColumn("embedding", embed(F.col("content"))), "vectors", lean=True)
    return fresh if stored is None else known.unionByName(fresh)


def ingest_runbooks(
    runbooks: DataFrame,
    services: DataFrame,
    stored: DataFrame | None = None,
    embed: Callable[[Column], Column] = embedding_column,
) -> tuple[DataFrame, DataFrame]:
    """(chunk table after the upsert, {runbooks, chunks} written).

    Vectors belong to contents: chunks of equal content share one, and what is stored
    already isn't embedded again. ``embed`` has to give a content the same vector always.

    Texts and vectors are most of the disk this takes. They are kept once per content, away
    from the chunks, which name theirs by its hash; only the result brings them together.
    """
    listed = with_service_name(spread(runbooks), services, "left")
    hashed = chunk_runbooks(listed).withColumn("content_hash", content_hash())
    with passing(hashed, "chunks") as chunks:
        vectors = content_vectors(chunks, stored, embed)
        heads = materialize(chunks.drop("content"), "chunk-heads", lean=True)
    written = runbooks.select(F.lit("runbook").alias("kind")).unionByName(
        heads.select(F.lit("chunk").alias("kind"))
    )
    counts = written.agg(
        F.count_if(F.col("kind") == "runbook").alias("runbooks"),
        F.count_if(F.col("kind") == "chunk").alias("chunks"),
    )
    if stored is None:
        # One content, a licence line say, may be that of many chunks.
        chunks = lookup_join(heads, vectors, ["content_hash"], spread=["id"])
        return chunks.select("id", "runbook_id", "chunk_index", "content", "metadata", "embedding"), counts
    return keyed.upsert_chunks(stored, heads.withColumn("batch_seq", F.lit(0)), contents=vectors), counts


def attach_passages(
    hits: DataFrame, chunks: DataFrame, runbooks: DataFrame, services: DataFrame
) -> DataFrame:
    """Text and titles of the chunks found; only chunks that were hit are read out."""
    wanted = hits.select(F.col("chunk_id").alias("id")).distinct()
    hit = sorted_join(chunks.select("id", "runbook_id", "chunk_index", "content"), wanted, "id", "left_semi")
    heads = runbooks.select(F.col("id").alias("runbook_id"), "title", "slug", "service_id")
    passages = sorted_join(hit.withColumnRenamed("id", "chunk_id"), heads, "runbook_id")
    # Most runbooks may have no service, so the look-up spreads that one key.
    named = lookup_join(passages, service_names(services), ["service_id"], "left", spread=["chunk_id"])
    passages = materialize(named.drop("service_id"), "passages")
    return lookup_join(hits, passages, ["chunk_id"], spread=["text", "rank"])


def search_runbooks(
    queries: DataFrame,
    chunks: DataFrame,
    runbooks: DataFrame,
    services: DataFrame,
    limit: int = SEARCH_LIMIT,
    vector: str = "content",
    to_vectors: Vectorize = text_vectors,
    to_query_vectors: Vectorize | None = None,
) -> DataFrame:
    """The nearest chunks of every distinct query text, with their passages.

    Another embedder is given as ``to_query_vectors`` for the texts and ``to_vectors`` for
    the chunk column ``vector``, which may hold stored vectors.
    """
    texts = queries.select("text").distinct().withColumn("key", F.col("text"))
    # The hits are used three times below; k rows per query are cheap to write.
    hits = vector_topk(
        texts,
        chunks,
        query_key="key",
        item_key="id",
        query_content="text",
        item_content=vector,
        to_vectors=to_vectors,
        to_query_vectors=to_query_vectors,
        limit=limit,
    ).withColumnsRenamed({"key": "text", "id": "chunk_id"})
    return attach_passages(materialize(hits, "hits"), chunks, runbooks, services)


def search_stored_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    runbooks: DataFrame,
    services: DataFrame,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """``search_runbooks`` over the vectors that an ingest has stored; chunks without one are skipped."""
    embedded = chunks.filter(F.col("embedding").isNotNull())
    return search_runbooks(
        queries, embedded, runbooks, services, limit,
        vector="embedding", to_vectors=dense_vectors, to_query_vectors=text_vectors,
    )


def incident_queries(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Search text of an incident: title, reason and service name."""
    named = with_service_name(incidents, services)
    text = F.concat_ws(" ", "title", "detection_reason", "service_name")
    return named.select(F.col("id").alias("incident_id"), text.alias("text"))


def incident_runbooks(
    incidents: DataFrame,
    services: DataFrame,
    chunks: DataFrame,
    runbooks: DataFrame,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """The nearest chunks per incident, whatever service they belong to.

    Incidents that ask the same question share one search.
    """
    queries = incident_queries(incidents, services)
    found = search_runbooks(queries, chunks, runbooks, services, limit)
    return lookup_join(queries, found, ["text"], spread=["incident_id"])
