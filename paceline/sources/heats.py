"""Sub-units of an event that its index page lists: enumerated, read one by one, fresh ones skipped, failures kept.

`listed` and `units` work on documents that are rows already. `HeatSource` is a data source over a folder with an index page and a
document per sub-unit: its partitions are the sub-units, so each is read by a task of its own, and one that is broken is a row with a failure.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paceline.sources.landed import cell_text, json_documents

SELECT = r"""(?is)<(?:el-)?select\b[^>]*\bname="heat"[^>]*>(.*?)</(?:el-)?select>"""
OPTION = r"""(?is)<(?:el-)?option\b[^>]*\bvalue="([^"]+)"[^>]*>(.*?)</(?:el-)?option>"""
SCHEMA = "heat string, label string, seq int, cells map<string,string>, failure string"


def listed(docs: DataFrame) -> DataFrame:
    """``source, seq, slug, label``: the options of each page's list of heats in their order; an option without a value is a prompt and no heat.

    A page without such a list gives none.
    """
    options = F.regexp_extract("body", SELECT, 1)
    slugs, labels = (F.regexp_extract_all(options, F.lit(OPTION), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(slugs.alias("slug"), F.transform(labels, cell_text).alias("label"))
    return docs.select("source", F.posexplode(pairs).alias("seq", "o")).select("source", "seq", "o.slug", "o.label")


def units(heats: DataFrame, docs: DataFrame, fresh: DataFrame, row: str) -> DataFrame:
    """Every listed heat with ``state`` and ``rows``: ``cached`` if it is among ``fresh`` (``source, slug``), else ``imported`` with its rows or ``failed``.

    ``docs`` are documents ``source, slug, body``, lists of ``row``. A heat without a document, or with a malformed one, has failed; of two documents of a heat
    the one that can be read counts. Documents of fresh heats aren't read, and those of heats that aren't listed are left out.
    """
    key = ["source", "slug"]
    known = fresh.select(*key).distinct().withColumn("_fresh", F.lit(True))
    asked = heats.join(known, key, "left")
    wanted = docs.join(asked.where("_fresh IS NULL").select(*key), key, "left_semi")
    read = json_documents(wanted.withColumn("body", F.concat(F.lit('{"rows":'), "body", F.lit("}"))), f"rows array<struct<{row}>>")
    read = read.where("NOT failed AND doc.rows IS NOT NULL").groupBy(*key).agg(F.min("doc.rows").alias("rows"))
    out = asked.join(read, key, "left")
    state = F.when(F.col("_fresh"), "cached").when(F.col("rows").isNotNull(), "imported").otherwise("failed")
    return out.select(*heats.columns, state.alias("state"), "rows")


def trace(of_units: DataFrame) -> DataFrame:
    """Per source the heats ``enumerated, imported, cached, failed``, of which the first is the sum of the others."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return of_units.groupBy("source").agg(F.count("*").alias("enumerated"), count("imported"), count("cached"), count("failed"))


class Heat(InputPartition):
    def __init__(self, seq: int, slug: str, label: str):
        self.seq, self.slug, self.label = seq, slug, label


class HeatReader(DataSourceReader):
    """Options ``path``, a folder of any store that Arrow knows; ``index`` (index.html); ``fresh``, slugs that are skipped, comma-separated."""

    def __init__(self, options: dict[str, str]):
        self.path, self.index = options["path"].rstrip("/"), options.get("index", "index.html")
        self.fresh = {s.strip() for s in options.get("fresh", "").split(",") if s.strip()}

    def text(self, name: str) -> str:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        with store.open_input_stream(f"{root}/{name}") as f:
            return f.read().decode()

    def partitions(self) -> list[Heat]:
        import re
        from html import unescape

        found = re.search(SELECT, self.text(self.index))
        options = re.findall(OPTION, found[1]) if found else []
        label = lambda x: " ".join(unescape(re.sub(r"(?s)<[^>]*>", " ", x)).split())
        return [Heat(k, slug, label(text)) for k, (slug, text) in enumerate(options) if slug not in self.fresh]

    def read(self, heat: Heat | None) -> Iterator[tuple]:
        if heat is None:  # nothing is listed, or all is fresh
            return
        try:
            rows = json.loads(self.text(f"{heat.slug}.json"))
            made = [{str(k): None if v is None else str(v) for k, v in r.items()} for r in rows]
        except Exception as e:  # one sub-unit that fails leaves the others as they are
            yield heat.slug, heat.label, heat.seq, None, f"{type(e).__name__}: {e}"
            return
        for cells in made:
            yield heat.slug, heat.label, heat.seq, cells, None


class HeatSource(DataSource):
    """``spark.dataSource.register(HeatSource)``, then ``spark.read.format("heats").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "heats"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeatReader:
        return HeatReader(dict(self.options))
