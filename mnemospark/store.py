"""The commands of a memory store as batch calls over DataFrames.

Every command takes its rows as a DataFrame, so one call serves many requests.  The
clock is the argument `at` of a call (a datetime); nothing reads the wall clock.
Embeddings come with the rows or queries; no model is called here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import duplicates, filters, fulltext, graph, lifecycle, links, ranking, rerank, vectors
from .sources import archive
from .sources.tables import SCHEMAS, Tables

# Silos of each new space and their policy, and the order of maintenance tasks.
SILOS = {"durable": "keep", "short-term": "ttl"}
TASKS = ["promote", "expire", "reindex", "dedupe", "link", "graph"]


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder)

    # --- set-up, spaces -------------------------------------------------------------
    def init(self, at: dt.datetime) -> None:
        """Create the default space; a store that has one is left as it is."""
        if not self.tables.versions("spaces"):
            self.space_create([filters.DEFAULT_SPACE], at)

    def space_create(self, names: list[str], at: dt.datetime) -> None:
        new = self.spark.createDataFrame([(n, at) for n in filters.values(names)], SCHEMAS["spaces"])
        new = new.join(self.tables.read("spaces").select("space"), "space", "left_anti")
        silos = new.select("space", F.explode(F.create_map(*[F.lit(x) for kv in SILOS.items() for x in kv])).alias("silo", "policy"))
        self.tables.append("silos", silos)
        self.tables.append("spaces", new)

    def space_list(self) -> DataFrame:
        per = lambda t, n: self.tables.read(t).groupBy("space").agg(F.count("*").alias(n))
        out = self.tables.read("spaces").join(per("memories", "memories"), "space", "left").join(per("episodes", "episodes"), "space", "left")
        return out.fillna(0, ["memories", "episodes"])

    def silo_list(self) -> DataFrame:
        n = self.tables.read("memories").groupBy("space", "silo").agg(F.count("*").alias("memories"))
        return self.tables.read("silos").join(n, ["space", "silo"], "left").fillna(0, ["memories"])

    # --- records --------------------------------------------------------------------
    def remember(self, rows: DataFrame, at: dt.datetime, mode: str = "append", derive_keys: bool = False) -> DataFrame:
        """Store rows (content, and any column of a memory); returns ids with status and superseded_by.

        Ids derive from space, content and arrival, so a repeated call repeats them.
        """
        old = self.tables.read("memories")
        start = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        has = set(rows.columns)
        get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in has else F.lit(d)
        new = rows.withColumn("space", get("space", filters.DEFAULT_SPACE)).withColumn("silo", get("silo", "durable")).withColumn("scope", get("scope", "workspace"))
        new = new.withColumn("kind", F.coalesce(F.col("kind") if "kind" in has else F.lit(None).cast("string"), X.kind_from_prefix(F.col("content")), F.lit("fact")))
        for c in ("entity_key", "claim_key", "summary"):
            new = new if c in has else new.withColumn(c, F.lit(None).cast("string"))
        if derive_keys:
            slug = X.entity_slug(F.coalesce(F.when(F.trim("summary") != "", F.trim("summary")), F.col("content")))
            new = new.withColumn("_slug", slug).withColumn("entity_key", F.coalesce("entity_key", F.concat(F.lit("auto:"), "_slug")))
            new = new.withColumn("claim_key", F.coalesce("claim_key", F.when(F.col("_slug").isNotNull(), F.concat(F.lit("auto:"), X.fingerprint("content"))))).drop("_slug")
        new = new.withColumn("pinned", get("pinned", False)).withColumn("confidence", get("confidence", 1.0)).withColumn("content_sha256", F.sha2("content", 256))
        new = new.withColumn("observed_at", F.coalesce(F.col("observed_at"), F.lit(at)) if "observed_at" in has else F.lit(at)).withColumn("created_at", F.lit(at)).withColumn("updated_at", F.lit(at))
        order = F.col("arrival") if "arrival" in has else F.col("content_sha256")
        # Arrival order is total by definition: numbered in one sort of (arrival, hash), no text.
        numbered = new.withColumn("seq", F.row_number().over(Window.partitionBy("space", "entity_key", "claim_key").orderBy(order, "content_sha256")) + start)
        numbered = numbered.withColumn("memory_id", F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\x1f", "space", F.coalesce("entity_key", F.lit("")), F.coalesce("claim_key", F.lit("")), "content_sha256", F.col("seq").cast("string")), 256), 1, 32)))
        numbered = numbered.withColumn("status", F.lit("active"))
        both = old.unionByName(numbered.select(*[c for c in old.columns if c in numbered.columns]), allowMissingColumns=True)
        keyed = both.filter(F.col("entity_key").isNotNull() & F.col("claim_key").isNotNull() & (F.col("status") == "active"))
        found = lifecycle.resolve(lifecycle.auto_supersede(keyed.drop("superseded_by"), ["space", "entity_key", "claim_key"], "seq", "observed_at", "memory_id"), mode)
        hit = found.filter("superseded_by is not null").select("memory_id", F.col("status").alias("_status"), F.col("superseded_by").alias("_by"), "link_type")
        out = both.join(hit.drop("link_type"), "memory_id", "left")
        out = out.withColumn("status", F.coalesce("_status", "status")).withColumn("superseded_by", F.when(F.col("_status") == "superseded", F.col("_by")).otherwise(F.col("superseded_by"))).drop("_status", "_by")
        self.tables.write("memories", out)
        made = self.tables.read("memories").filter(F.col("seq") > start)
        if mode != "append":
            self.tables.append("links", hit.select(F.col("_by").alias("src"), F.col("memory_id").alias("dst"), "link_type", F.lit(1.0).alias("confidence"), F.lit(at).alias("created_at")))
        self._log(made.select("memory_id"), "remembered", at)
        return made.select("memory_id", "space", "kind", "entity_key", "claim_key", "status", "superseded_by")

    def _log(self, ids: DataFrame, event: str, at: dt.datetime, reason: str | None = None, new_status: str | None = None) -> None:
        self.tables.append("events", ids.select("memory_id", F.lit(event).alias("event_type"), F.lit(new_status).cast("string").alias("new_status"), F.lit(reason).cast("string").alias("reason"), F.lit(at).alias("created_at")))

    def candidates_for(self, rows: DataFrame) -> DataFrame:
        """Write-time duplicate report of the active memories `rows` (memory_id)."""
        m = self.memories(["*"])
        ids = rows.select("memory_id").distinct()
        return duplicates.candidates(m, m.join(ids, "memory_id", "left_semi")).join(ids.withColumnRenamed("memory_id", "id"), "id", "left_semi")

    def memories(self, spaces: list[str] | None = None, statuses: list[str] | None = None, **columns) -> DataFrame:
        tags = filters.values(columns.pop("tags", None))
        m = self.tables.read("memories").filter(filters.spaces(spaces) & filters.statuses(statuses) & filters.within(**columns))
        return m.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else m

    def memory_list(self, limit: int = 50, offset: int = 0, order: str = "updated_desc", **where) -> DataFrame:
        by = {"updated_desc": "updated_at", "observed_desc": "observed_at", "created_desc": "created_at"}[order]
        return ranking.page(self.memories(**where), "space", [F.desc(by), F.asc("memory_id")], limit, offset)

    def get(self, ids: DataFrame) -> DataFrame:
        e = self.tables.read("events").groupBy("memory_id").agg(F.count("*").alias("events"))
        return self.tables.read("memories").join(ids.select("memory_id").distinct(), "memory_id", "left_semi").join(e, "memory_id", "left")

    def _change(self, ids: DataFrame, **columns) -> None:
        marked = self.tables.read("memories").join(ids.select("memory_id").distinct().withColumn("_hit", F.lit(True)), "memory_id", "left")
        for c, v in columns.items():
            marked = marked.withColumn(c, F.when(F.col("_hit"), v).otherwise(F.col(c)))
        self.tables.write("memories", marked)

    def forget(self, ids: DataFrame, at: dt.datetime, reason: str) -> None:
        self._change(ids, status=F.lit("tombstoned"), updated_at=F.lit(at))
        self._log(ids, "forgotten", at, reason, "tombstoned")

    def verify(self, ids: DataFrame, against: str, at: dt.datetime) -> None:
        self._change(ids, metadata_json=lifecycle.merge_map(F.col("metadata_json"), verified_at=F.lit(at.isoformat()), verified_against=F.lit(against)))

    def history(self, ids: DataFrame, limit: int = 500) -> DataFrame:
        return ranking.top_k(self.tables.read("events").join(ids.select("memory_id").distinct(), "memory_id", "left_semi"), "memory_id", [F.asc("created_at"), F.asc("event_type")], limit)

    def recall_log(self, rows: DataFrame) -> None:
        """Append recall events; memories that were retrieved get their last time as accessed_at."""
        self.tables.append("recall", rows)
        last = rows.filter("kind = 'retrieved'").groupBy("memory_id").agg(F.max("ts").alias("_ts"))
        m = self.tables.read("memories").join(last, "memory_id", "left")
        self.tables.write("memories", m.withColumn("accessed_at", F.greatest("accessed_at", "_ts")))

    # --- retrieval ------------------------------------------------------------------
    def _score(self, relevance, at: dt.datetime, alias_hit, where: dict):
        """Relevance, metadata hits of what the request filters by, recency, scope, status, pin and source tier."""
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        found = ranking.hits(where.get("kind") or (), where.get("entity_key") or (), where.get("claim_key") or (), where.get("tags") or ())
        score = relevance + ranking.metadata(F.col("confidence"), *found, alias_hit) + ranking.recency(F.greatest("updated_at", "observed_at"), F.col("silo"), F.lit(at))
        return score + ranking.standing(where.get("scope") or ()) + ranking.source_tier(F.coalesce(F.get_json_object("source_json", "$.type"), F.lit("")), tags)

    def search(self, queries: DataFrame, at: dt.datetime, limit: int = 10, include_source: bool = False, **where) -> DataFrame:
        """queries: query_id, text.  Tiered lexical search with final scores.  With include_source the
        sources of records are searched too, with statistics of their own."""
        m = self.memories(**where).filter(lifecycle.visible(F.lit(at)))
        docs = m.select(F.col("memory_id").alias("id"), F.concat_ws("\n\n", "summary", "content", *(["source_json"] if include_source else [])).alias("text"))
        pool = fulltext.tiered(docs, queries, limit).drop("rank")
        best = pool.groupBy("query_id").agg(F.min("bm25").alias("best"))
        alias = queries.select("query_id", X.shingles(F.regexp_extract_all(X.ascii_lower(F.col("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("q_shingles"), X.query_terms(F.col("text")).alias("q_terms"))
        rows = pool.join(best, "query_id").join(m.withColumnRenamed("memory_id", "id"), "id").join(alias, "query_id")
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        boost = F.exists(tags, lambda t: t.startswith("alias::") & F.array_contains("q_shingles", F.substring(t, 8, 300)))
        score = self._score(ranking.relative(F.col("bm25"), F.col("best")), at, boost, where)
        out = ranking.top_k(rows.withColumn("score", F.round(score, 9)), "query_id", [F.asc("tier"), F.desc("score"), F.desc("observed_at"), F.asc("id")], limit)
        return out.select("query_id", F.col("id").alias("memory_id"), "rank", "tier", "score", "space", "kind", X.snippet(F.col("content"), F.col("q_terms"), 160).alias("snippet"), "content")

    def semantic_search(self, queries: DataFrame, at: dt.datetime, limit: int = 10, **where) -> DataFrame:
        """queries: query_id, embedding.  The filters come after the nearest; final scores as in search()."""
        every = self.tables.read("memories").filter("embedding is not null").select(F.col("memory_id").alias("id"), "embedding")
        near = vectors.knn(queries, every, ranking.pool_size(limit)).drop("rank")
        kept = near.join(self.memories(**where).withColumnRenamed("memory_id", "id"), "id")
        kept = kept.withColumn("score", F.round(self._score(vectors.semantic_score(F.col("distance")), at, F.lit(False), where), 9))
        out = ranking.top_k(kept, "query_id", [F.desc("score"), F.desc("observed_at"), F.asc("id")], limit)
        return out.select("query_id", F.col("id").alias("memory_id"), "rank", "distance", "score", "space", "kind", "content")

    def pool_trace(self, queries: DataFrame, at: dt.datetime, cap: int = 16, **where) -> DataFrame:
        """Candidates of both arms interleaved, with the arm of admission and what the cap dropped."""
        lists = self.search(queries.select("query_id", "text"), at, ranking.pool_size(cap), **where).select("query_id", F.col("memory_id").alias("id"), "rank", F.lit(1).alias("arm"))
        if "embedding" in queries.columns:
            lists = lists.unionByName(self.semantic_search(queries.select("query_id", "embedding"), at, ranking.pool_size(cap), **where).select("query_id", F.col("memory_id").alias("id"), "rank", F.lit(0).alias("arm")))
        return ranking.interleave(lists, "query_id", "arm", 1_000_000_000).withColumn("dropped", F.when(F.col("position") > cap, "hybrid_cap"))

    def pack(self, queries: DataFrame, at: dt.datetime, budget: int = 8000, limit: int = 20, min_score: float = 0.0, **where) -> DataFrame:
        """Lines within a budget of characters for each group of queries (query_id, text, and optionally pack)."""
        q = queries if "pack" in queries.columns else queries.withColumn("pack", F.lit(1))
        found = self.search(q.select("query_id", "text"), at, limit, **where).join(q.select("query_id", "pack"), "query_id")
        lists = found.select("pack", F.col("memory_id").alias("id"), "rank", F.col("query_id").alias("query_index"))
        chosen = ranking.interleave(lists, "pack", "query_index", limit)
        one = found.groupBy("pack", F.col("memory_id").alias("id")).agg(F.first("kind").alias("kind"), F.first("content").alias("content"))
        gate = found.groupBy("pack").agg(F.max("score").alias("top")).filter(F.col("top") >= min_score)
        rows = chosen.join(one, ["pack", "id"]).join(gate, "pack", "left_semi").withColumnRenamed("position", "order")
        return ranking.pack(rows, "pack", [F.asc("order")], F.concat(F.lit("- ("), "kind", F.lit(") "), X.collapse(F.col("content"))), budget)

    def rerank(self, pairs: DataFrame, scorer=None) -> DataFrame:
        """pairs: query_id, id, rank, query, document."""
        return rerank.ordered(rerank.scored(pairs, scorer).withColumn("consensus", F.lit(False)).withColumn("activation", F.lit(None).cast("double")))

    # --- documents ------------------------------------------------------------------
    def ingest(self, chunks: DataFrame, at: dt.datetime) -> None:
        """chunks: space, source_path, chunk_index, content, and optionally provenance and embedding.

        A chunk of known (space, text, path) repairs the provenance, others are inserted.
        """
        new = chunks.withColumn("content_sha256", F.sha2("content", 256)).withColumn("chunk_count", F.count("*").over(Window.partitionBy("space", "source_path"))).withColumn("seq", F.col("chunk_index"))
        for c, t in (("provenance", "string"), ("embedding", "array<float>")):
            new = new if c in new.columns else new.withColumn(c, F.lit(None).cast(t))
        key = F.concat_ws("\x1f", "space", "content_sha256", F.coalesce("source_path", F.lit("\x00")))
        new = new.withColumn("id", F.concat(F.lit("doc_"), F.substring(F.sha2(key, 256), 1, 32))).withColumn("ingest_status", F.lit("pending")).withColumn("created_at", F.lit(at))
        old = self.tables.read("episodes")
        values = [c for c in old.columns if c not in ("id", "chunk_index", "ingest_status", "created_at")]
        merged = lifecycle.upsert(old.select("id", *values), new.select("id", *values, "seq"), ["id"], values)
        first = old.select("id", "chunk_index", "ingest_status", "created_at").unionByName(new.select("id", "chunk_index", "ingest_status", "created_at"))
        kept = first.groupBy("id").agg(F.min(F.struct("created_at", "chunk_index", "ingest_status")).alias("f")).select("id", "f.*")
        self.tables.write("episodes", merged.join(kept, "id"))

    def document_search(self, queries: DataFrame, limit: int = 10, spaces: list[str] | None = None) -> DataFrame:
        docs = self.tables.read("episodes").filter(filters.spaces(spaces)).select("id", F.col("content").alias("text"))
        lexical = fulltext.search(docs, queries.select("query_id", "text"), ranking.pool_size(limit))
        if "embedding" not in queries.columns:
            return lexical.filter(F.col("rank") <= limit)
        every = self.tables.read("episodes").filter("embedding is not null").select("id", "embedding")
        near = vectors.knn(queries.select("query_id", "embedding"), every, ranking.pool_size(limit)).join(docs.select("id"), "id", "left_semi")
        return ranking.rrf({"lexical": lexical, "semantic": near}, limit)

    def document_get(self, path: str) -> DataFrame:
        return self.tables.read("episodes").filter(F.col("source_path") == path).orderBy("chunk_index", "id")

    def document_duplicates(self) -> DataFrame:
        return self.tables.read("episodes").groupBy("space", "content_sha256").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("source_path", "id"))).alias("members")).filter("n > 1")

    def document_prune(self, ids: DataFrame, space: str, dry_run: bool = True) -> int:
        e = self.tables.read("episodes")
        gone = e.filter(F.col("space") == space).join(ids.select("id").distinct(), "id", "left_semi").select("id")
        n = gone.count()
        if n and not dry_run:
            self.tables.write("episodes", e.join(gone, "id", "left_anti"))
        return n

    def mark_extracted(self, ids: DataFrame) -> None:
        hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
        self.tables.write("episodes", self.tables.read("episodes").join(hit, "id", "left").withColumn("ingest_status", F.when(F.col("_hit"), "extracted").otherwise(F.col("ingest_status"))))

    def promotion_candidates(self, hits: int = 3, queries: int = 2) -> DataFrame:
        r = self.tables.read("recall").groupBy("memory_id").agg(F.count("*").alias("hits"), F.count_distinct("query").alias("queries"), F.max("ts").alias("last_hit"))
        return r.filter((F.col("hits") >= hits) & (F.col("queries") >= queries))

    # --- graph ----------------------------------------------------------------------
    def entity_upsert(self, rows: DataFrame) -> None:
        """rows: space, entity_id, entity_type, canonical_name, status, aliases, seq."""
        values = ["entity_type", "canonical_name", "status", "aliases"]
        self.tables.write("entities", lifecycle.upsert(self.tables.read("entities"), rows, ["space", "entity_id"], values))

    def relationship_upsert(self, rows: DataFrame) -> None:
        """rows: space, subject, object, rel_type, memory_id, status, confidence, seq."""
        keys = ["space", "subject", "object", "rel_type", "memory_id"]
        out = lifecycle.upsert(self.tables.read("relationships"), rows, keys, ["status", "confidence"])
        self.tables.write("relationships", out.withColumn("edge_id", F.xxhash64(*keys)))

    def entity_merge(self, source: str, target: str) -> None:
        e = graph.merge(self.tables.read("relationships"), source, target)
        self.tables.write("relationships", e.withColumn("status", F.when(F.col("outcome").isin("self_loop", "duplicate"), "tombstoned").otherwise(F.col("status"))))
        n = self.tables.read("entities")
        self.tables.write("entities", n.withColumn("status", F.when(F.col("entity_id") == source, "tombstoned").otherwise(F.col("status"))))

    def entity_search(self, part: str, statuses: list[str] | None = None) -> DataFrame:
        low = X.ascii_lower(F.lit(part))
        hit = F.contains(F.lower("entity_id"), low) | F.contains(F.lower("canonical_name"), low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), low))
        return self.tables.read("entities").filter(hit & filters.statuses(statuses))

    def _edges(self) -> DataFrame:
        return self.tables.read("relationships").filter("status = 'active'")

    def graph_neighbors(self, seeds: DataFrame, depth: int = 1, limit: int = 200) -> DataFrame:
        return graph.neighbours(self._edges(), seeds, depth, limit)

    def graph_context(self, seeds: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
        about = self.memories(["*"]).select("memory_id", F.col("entity_key").alias("node")).filter("node is not null")
        return graph.context(self._edges(), seeds, about, depth, limit)

    def graph_full(self) -> DataFrame:
        return graph.half_edges(self._edges()).groupBy("node").agg(F.count("*").alias("degree"))

    # --- review queue ---------------------------------------------------------------
    def candidate_submit(self, rows: DataFrame, at: dt.datetime) -> None:
        self.tables.append("candidates", rows.withColumn("candidate_id", F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("\x1f", "space", "content"), 256), 1, 32))).withColumn("status", F.lit("pending")).withColumn("created_at", F.lit(at)))

    def candidate_list(self, statuses: list[str] | None = None) -> DataFrame:
        return self.tables.read("candidates").filter(F.col("status").isin(statuses or ["pending"]))

    def candidate_decide(self, ids: DataFrame, decision: str, at: dt.datetime) -> int:
        """approved, rejected or quarantined; only pending ones change, approved ones are remembered."""
        if decision not in ("approved", "rejected", "quarantined"):
            raise ValueError(f"no decision {decision}")
        c = self.tables.read("candidates")
        hit = c.filter("status = 'pending'").join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
        n = hit.count()
        if n and decision == "approved":
            self.remember(hit.select("space", "content", "kind"), at)
        if n:
            self.tables.write("candidates", c.join(hit.select("candidate_id").withColumn("_hit", F.lit(True)), "candidate_id", "left").withColumn("status", F.when(F.col("_hit"), decision).otherwise(F.col("status"))))
        return n

    # --- maintenance ----------------------------------------------------------------
    def dream(self, at: dt.datetime, tasks: list[str] | None = None, dry_run: bool = False, threshold: int = 3) -> dict[str, DataFrame]:
        """Run tasks in their fixed order; returns what each found.  A dry run changes nothing."""
        chosen = [t for t in TASKS if t in filters.values(tasks or TASKS, TASKS)]
        out = {}
        for task in chosen:
            m = self.tables.read("memories")
            if task == "promote":
                good = self.tables.read("recall").filter("session_id is not null and score >= 0.5 and rank <= 3").groupBy("memory_id").agg(F.count_distinct("session_id").alias("sessions")).filter(F.col("sessions") >= threshold)
                found = m.filter("silo = 'short-term' and status = 'active'").join(good, "memory_id").select("memory_id", "sessions")
                change = {"silo": F.lit("durable"), "expires_at": F.lit(None).cast("timestamp")}
            elif task == "expire":
                found, change = m.filter((F.col("status") == "active") & ~F.col("pinned") & (F.col("expires_at") <= F.lit(at))).select("memory_id", "expires_at"), {"status": F.lit("expired")}
            elif task == "dedupe":
                w = Window.partitionBy("space", "content_sha256")
                found, change = m.filter("status = 'active'").withColumn("canonical", F.first("memory_id").over(w.orderBy(F.desc("pinned"), "memory_id"))).filter("memory_id <> canonical").select("memory_id", "canonical"), {}
            elif task == "link":
                tagged = m.select("memory_id", "space", "entity_key", "status", F.explode("tags").alias("tag"))
                found = links.tag_links(tagged).select("src", "dst", F.lit("related_to").alias("link_type"), "confidence")
                found, change = links.new_links(found, self.tables.read("links")), {}
                if not dry_run:
                    self.tables.append("links", found.withColumn("created_at", F.lit(at)))
            elif task == "graph":
                have = self.tables.read("entities").select("space", F.col("entity_id").alias("entity_key"))
                found, change = m.filter("status = 'active' and entity_key is not null").select("space", "entity_key").distinct().join(have, ["space", "entity_key"], "left_anti").withColumn("canonical_name", X.canonical_name(F.col("entity_key"))), {}
            else:
                found, change = m.agg(F.count("*").alias("indexed")), {}
            out[task] = found
            if change and not dry_run:
                self._change(found.select("memory_id"), **change)
        if not dry_run:
            self.tables.append("runs", self.spark.createDataFrame([(at.isoformat(), ",".join(chosen), False, at, "")], SCHEMAS["runs"]))
        return out

    def stats(self) -> DataFrame:
        return self.tables.read("memories").groupBy("space").agg(F.count("*").alias("memories"), *[F.count_if(F.col("status") == s).alias(s) for s in filters.STATUSES], F.count_if("pinned").alias("pinned"), F.count_if(F.col("entity_key").isNull()).alias("missing_keys"), F.count_if(F.col("embedding").isNull()).alias("missing_embedding"))

    def doctor(self) -> DataFrame:
        """Counts of broken invariants."""
        m = self.tables.read("memories")
        return m.agg(F.count_if(F.col("content_sha256") != F.sha2("content", 256)).alias("bad_hash"), F.count_if(~F.col("status").isin(filters.STATUSES)).alias("bad_status"), F.count_if(~F.col("confidence").between(0, 1)).alias("bad_confidence"), (F.count("*") - F.count_distinct("memory_id")).alias("repeated_ids"))

    def export(self, path: str) -> DataFrame:
        order = {"memories": ["memory_id"], "links": ["src", "dst", "link_type"], "episodes": ["id"], "entities": ["space", "entity_id"], "relationships": ["edge_id"], "recall": ["memory_id", "ts"], "events": ["memory_id", "created_at"], "spaces": ["space"], "silos": ["space", "silo"], "candidates": ["candidate_id"], "runs": ["run_id"]}
        return archive.export({t: (self.tables.read(t), o) for t, o in order.items()}, path)

    def load(self, path: str) -> DataFrame:
        """Import an archive into this (empty) store; returns its bad lines."""
        if any(self.tables.versions(t) for t in SCHEMAS):
            raise ValueError("the store is not empty")
        found, bad = archive.load(self.spark, path, {t: self.spark.createDataFrame([], s).schema for t, s in SCHEMAS.items()})
        for t, df in found.items():
            self.tables.write(t, df)
        return bad

    def backup(self, to: str) -> None:
        for t in SCHEMAS:
            self.tables.read(t).write.mode("errorifexists").parquet(f"{to.rstrip('/')}/{t}")
