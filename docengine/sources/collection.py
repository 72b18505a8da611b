"""A collection of records by id in versions: writers add one, readers see the last that is complete."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.shared import Files

#: Columns of chunks that go with a vector (fixed values).
METADATA_FIELDS = (
    "chunk_id", "corpus_id", "retrieval_namespace", "document_id", "doc_id", "document", "document_title", "document_type", "source_category", "denomination", "tradition", "tradition_family", "tradition_branch", "language",
    "chunk_type", "content_role", "is_doctrinal", "document_structure_type", "section_title", "section_reference", "subsection_title", "chapter_title", "chapter_reference", "article_number", "paragraph_number",
    "paragraph_label", "paragraph_number_roman", "inciso", "alinea", "full_reference", "biblical_references", "page_start", "page_end", "source_path", "normalized_source", "text_hash",
)


def index_metadata(chunks: DataFrame, fields: tuple[str, ...] = METADATA_FIELDS) -> Column:
    """The given fields of a chunk as one JSON object: what is null or lacks is left out, lists and records stand as JSON text."""
    kinds = {f.name: f.dataType.typeName() for f in chunks.schema}
    flat = lambda c: F.to_json(c) if kinds[c] in ("array", "struct", "map") else F.col(c)
    return F.to_json(F.struct(*[flat(c).alias(c) for c in fields if c in kinds]))


class Collection:
    """Records by key under one path.

    A version is a small file that names layers, folders that Spark wrote. An
    upsert writes a layer and then its version, in one rename; a job that ends
    before that leaves what readers see as it was, and its layer is not named by any version. Of two writers of one version
    the second fails. A reader takes the row of the last layer for each key: one shuffle
    by key, none where there is a single layer. compact() makes one of all layers.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", **properties: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.files = Files(spark, self.path)
        if not self._versions():
            self._commit(0, {"key": key, "layers": [], "properties": properties})

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))

    def _commit(self, version: int, what: dict) -> None:
        self.files.put(f"versions/{version:08d}.json", json.dumps(what))

    def _at(self, version: int | None = None) -> tuple[int, dict]:
        version = self._versions()[-1] if version is None else version
        return version, json.loads(self.files.read(f"versions/{version:08d}.json"))

    @property
    def version(self) -> int:
        return self._versions()[-1]

    @property
    def properties(self) -> dict[str, str]:
        return self._at()[1]["properties"]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The records of a version, the last if none is given; None while there are no layers."""
        layers = self._at(version)[1]["layers"]
        frames = [self.spark.read.schema(x["schema"]).parquet(f"{self.path}/{x['folder']}") for x in layers]
        if len(frames) < 2:
            return frames[0] if frames else None
        every = None
        for n, frame in enumerate(frames):
            tagged = frame.withColumn("_layer", F.lit(n))
            every = tagged if every is None else every.unionByName(tagged, allowMissingColumns=True)
        rows = F.struct("_layer", *[c for c in every.columns if c not in ("_layer", self.key)])
        last = every.groupBy(self.key).agg(F.max_by(rows, "_layer").alias("_r"))
        return last.select(self.key, "_r.*").drop("_layer")

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def _add(self, rows: DataFrame, after: list[dict], version: int, what: dict) -> None:
        target = f"layers/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{target}")
        self._commit(version + 1, what | {"layers": [*after, {"folder": target, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}]})

    def upsert(self, rows: DataFrame) -> None:
        """Adds records and replaces those of equal keys. Of rows that repeat a key one is kept; rows without a key are refused."""
        version, what = self._at()
        keyed = rows.where(F.col(self.key).isNotNull() | F.raise_error(F.lit(f"a record without {self.key}")).cast("boolean"))
        self._add(keyed.dropDuplicates([self.key]), what["layers"], version, what)

    def compact(self) -> None:
        version, what = self._at()
        if len(what["layers"]) > 1:
            self._add(self.read(), [], version, what)

    def reset(self) -> None:
        """No records from now on; older versions can still be read."""
        version, what = self._at()
        self._commit(version + 1, what | {"layers": []})

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the last `keep`, and layers that none of those names."""
        versions = self._versions()
        kept = {layer["folder"] for v in versions[-keep:] for layer in self._at(v)[1]["layers"]}
        for v in versions[:-keep]:
            self.files.remove(f"versions/{v:08d}.json")
        for name in self.files.names("layers"):
            if f"layers/{name}" not in kept:
                self.files.remove(f"layers/{name}")
