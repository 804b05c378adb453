"""Tables of a store: Parquet folders, one version a write; readers take the last complete one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "spaces": "space string, created_at timestamp",
    "silos": "space string, silo string, policy string",
    "memories": "memory_id string, space string, silo string, scope string, kind string, entity_key string, claim_key string, status string, superseded_by string, pinned boolean, confidence double, content string, summary string, content_sha256 string, tags array<string>, source_json string, metadata_json string, observed_at timestamp, created_at timestamp, updated_at timestamp, accessed_at timestamp, expires_at timestamp, valid_to timestamp, seq long, embedding array<float>",
    "events": "memory_id string, event_type string, old_status string, new_status string, reason string, created_at timestamp",
    "links": "src string, dst string, link_type string, confidence double, created_at timestamp",
    "episodes": "id string, space string, source_path string, content string, content_sha256 string, chunk_index long, chunk_count long, ingest_status string, provenance string, created_at timestamp, embedding array<float>",
    "recall": "memory_id string, ts timestamp, kind string, query string, rank long, score double, session_id string",
    "entities": "entity_id string, space string, entity_type string, canonical_name string, status string, aliases array<string>",
    "relationships": "edge_id long, space string, subject string, object string, rel_type string, status string, confidence double, memory_id string",
    "candidates": "candidate_id string, space string, content string, kind string, status string, created_at timestamp",
    "runs": "run_id string, tasks string, dry_run boolean, started_at timestamp, summary string",
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Complete versions: those with the mark that Spark's writer leaves last."""
        fs, p = self._fs(f"{self.folder}/{name}")
        if not fs.exists(p):
            return []
        found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().isdigit()]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getName()) for f in found if fs.exists(done(f, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{found[-1]:08d}")

    def write(self, name: str, df: DataFrame) -> None:
        """A new version with the table's columns, cast; earlier versions stay for their readers."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        from pyspark.sql import functions as F

        rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        rows.write.parquet(f"{self.folder}/{name}/{(self.versions(name) or [0])[-1] + 1:08d}")

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(df.select(*[c for c in df.columns if c in self.read(name).columns]), allowMissingColumns=True))
