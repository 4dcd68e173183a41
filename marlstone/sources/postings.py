"""Posting sources: a registry, a Python data source with filter pushdown, JSON boards, strict corpora, and sinks.

``spark.read.format("postings").option("path", dir)`` reads folders ``provider=P/source=S/*.json`` (one JSON posting a line), one partition a
file; dir may be any location that Arrow's file systems know.  Equality filters on provider and source prune files; filters on other
columns that the reader takes over are applied as it reads; the rest Spark applies itself.  A line that is no JSON object comes out as a
row with an error instead of a posting.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ..functions.html import html_to_text, redact_contacts
from ..functions.keys import derived_id
from ..functions.primitives import aware_timestamp, is_https_url, is_meaningful, is_usable_id
from ..functions.urls import normalize_url
from ..operators import ranking

POSTING = "provider string, source string, source_tenant_id string, source_job_id string, requisition_id_raw string, title string, company string, location string, source_url string, apply_url string, canonical_url string, description string, compensation_text string, posted_at string, discovered_at string, raw string"
READ = POSTING + ", error string"
_COLUMNS = [c.split()[0] for c in POSTING.split(", ")]
_SLUG = re.compile(r"[a-z0-9][a-z0-9._-]*")


class _File(InputPartition):
    def __init__(self, path: str, provider: str, source: str):
        self.path, self.provider, self.source = path, provider, source


class PostingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.equal = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.equal.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("provider",), ("source",))):  # these come from the folders
                yield f  # Spark applies what is given back

    def _keeps(self, **known: str) -> bool:
        return all(known[c] in values for c, values in self.equal if c in known)

    def partitions(self) -> list[InputPartition]:
        fs, root = _location(self.root)
        out = []
        for f in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            parts = dict(p.split("=", 1) for p in f.path.split("/")[:-1] if "=" in p)
            if f.is_file and f.path.endswith(".json") and {"provider", "source"} <= set(parts) and self._keeps(provider=parts["provider"], source=parts["source"]):
                out.append(_File(f.path, parts["provider"], parts["source"]))
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True)
        with _location(self.root)[0].open_input_stream(partition.path) as f:
            for line in _lines(f):
                if not line.strip():
                    continue
                known, error = {"provider": partition.provider, "source": partition.source}, None
                try:
                    row = json.loads(line)
                    if not isinstance(row, dict):
                        raise ValueError(line)
                except ValueError:
                    row, error = {}, "not a JSON object"
                row |= known
                if all(row.get(c) in values for c, values in self.equal):
                    yield (*(cell(row.get(c)) for c in _COLUMNS), error)


def _location(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def _lines(f) -> Iterator[bytes]:
    """Lines of a stream, read in blocks."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    yield rest


def health(root: str) -> str | None:
    """What is wrong with a folder of postings; None if it can be read."""
    try:
        fs, at = _location(root)
        return None if fs.get_file_info(at).type == pafs.FileType.Directory else "no such folder"
    except (OSError, ValueError) as e:
        return str(e)


class PostingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> PostingReader:
        return PostingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PostingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Registry:
    """Named sources of postings; names are slugs and unique, listing is sorted."""

    def __init__(self, providers: dict[str, object] | None = None):
        self._providers: dict[str, object] = {}
        for name, provider in (providers or {}).items():
            self.add(name, provider)

    def add(self, name: str, provider: object) -> None:
        if not _SLUG.fullmatch(name):
            raise ValueError(f"not a slug: {name!r}")
        if name in self._providers:
            raise ValueError(f"registered twice: {name}")
        if getattr(provider, "name", name) != name:
            raise ValueError(f"{name} calls itself {provider.name}")
        self._providers[name] = provider

    def names(self) -> list[str]:
        return sorted(self._providers)

    def get(self, name: str) -> object:
        if name not in self._providers:
            raise KeyError(f"no provider {name}")
        return self._providers[name]


def fixture(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Postings from dictionaries."""
    return spark.createDataFrame([tuple(r.get(c) for c in _COLUMNS) for r in rows], POSTING)


LARGEST_BODY = 5_000_000  # bytes of a response


def board_postings(boards: DataFrame, provider: str, fetched_at) -> DataFrame:
    """Postings of board responses (board, body; code and content_type where there are such columns): ``jobs`` lists of JSON objects.
    Responses that are no success, no JSON by their type, too large or no such object, and jobs without a usable id, an https URL and a
    dated publication, come out with an error instead of a posting."""
    v = F.col("job")
    refused = F.when(F.octet_length("body") > LARGEST_BODY, "response too large")
    if "code" in boards.columns:
        refused = F.coalesce(F.when(~F.coalesce(F.col("code").between(200, 299), F.lit(False)), "no success"), refused)
    if "content_type" in boards.columns:
        refused = F.coalesce(refused, F.when(~F.coalesce(F.lower("content_type").rlike(r"\Aapplication/json\s*(;|\z)"), F.lit(False)), "no JSON by its type"))
    body = boards.withColumn("refused", refused).withColumn("parsed", F.when(F.col("refused").isNull(), F.try_parse_json("body")))
    listed = body.withColumn("jobs", F.try_variant_get("parsed", "$.jobs", "array<variant>"))
    bad = listed.filter(F.col("jobs").isNull() | (F.size("jobs") == 0)).select("board", F.lit(None).cast("variant").alias("job"), F.coalesce("refused", F.lit("no jobs in response")).alias("error"))
    jobs = listed.filter(F.size("jobs") > 0).select("board", F.explode("jobs").alias("job")).withColumn("error", F.lit(None).cast("string"))
    get = lambda path: F.try_variant_get(v, path, "string")
    url, published = get("$.absolute_url"), get("$.first_published")
    out = jobs.union(bad).select(
        F.lit(provider).alias("provider"),
        F.col("board").alias("source"),
        F.col("board").alias("source_tenant_id"),
        get("$.id").alias("source_job_id"),
        get("$.requisition_id").alias("requisition_id_raw"),
        get("$.title").alias("title"),
        get("$.company_name").alias("company"),
        get("$.location.name").alias("location"),
        url.alias("source_url"),
        normalize_url(url).alias("canonical_url"),
        get("$.content").alias("content"),
        aware_timestamp(published).alias("posted_at"),
        F.lit(fetched_at).cast("timestamp").alias("discovered_at"),
        F.coalesce("error", F.when(~F.coalesce(is_usable_id(F.try_variant_get(v, "$.id", "variant")), F.lit(False)), "unusable id").when(~is_https_url(url), "no https URL").when(published.isNotNull() & aware_timestamp(published).isNull(), "date without offset")).alias("error"),
    )
    return out


def sanitized(postings: DataFrame) -> DataFrame:
    """title, location, description and compensation as text without contacts; rows whose title or description say nothing are dropped."""
    text = html_to_text(F.col("description"))
    out = postings.select("source", "source_job_id", redact_contacts(F.col("title")).alias("title"), redact_contacts(F.col("location")).alias("location"), redact_contacts(text["text"]).alias("description"), redact_contacts(F.col("compensation_text")).alias("compensation_text"))
    return out.filter(is_meaningful(F.col("title")) & is_meaningful(F.col("description")))


def read_corpus(spark: SparkSession, path: str, schema: str, id_col: str | None = None) -> DataFrame:
    """A JSON corpus (one array of objects a file) with a closed schema: other fields, fields given twice, values of another type and,
    with id_col, ids that are missing or repeated are errors."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.parse_json("value").cast("array<variant>")).alias("v"))  # a name given twice in an object is an error of the parser
    kind = spark.createDataFrame([], schema).schema
    given = F.map_keys(F.col("v").cast("map<string,variant>"))
    extra = F.array_except(given, F.array(*[F.lit(f.name) for f in kind.fields]))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))).cast("variant")).otherwise(F.col("v"))
    out = items.select(checked.alias("v")).select(*[F.variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kind.fields])
    if id_col is None:
        return out
    n = F.count("*").over(Window.partitionBy(id_col))
    wrong = F.col(id_col).isNull() | (n > 1)
    return out.withColumn(id_col, F.when(wrong, F.raise_error(F.concat(F.lit("missing or repeated id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast(kind[id_col].dataType)).otherwise(F.col(id_col)))


def acquired(candidates: DataFrame, *, per_board: int = 10, least_boards: int = 2) -> DataFrame:
    """Of each board (board, source_job_id, title, description) the first usable postings, ids as text and each once; an error if fewer
    boards than ``least_boards`` have any."""
    usable = candidates.filter(is_meaningful(F.col("title")) & is_meaningful(F.col("description")))
    once = usable.groupBy("board", F.col("source_job_id").cast("string").alias("source_job_id")).agg(F.min(F.struct("title", "description")).alias("r"))
    taken = ranking.top_k(once, "board", [F.col("source_job_id")], per_board).select("board", "source_job_id", "r.title", "r.description")
    boards = taken.agg(F.count_distinct("board").alias("n"))
    enough = boards.select(F.when(F.col("n") < least_boards, F.raise_error(F.lit("too few boards have usable postings")).cast("boolean")).otherwise(F.lit(True)).alias("enough"))
    return taken.join(F.broadcast(enough)).filter("enough").drop("enough")  # one row, by construction


def replay(postings: DataFrame, fields: dict[str, object]) -> DataFrame:
    """A source of one captured posting: it filters by nothing, so a query with any field is an error, as is any other number of postings."""
    if used := sorted(k for k, v in fields.items() if v):
        raise ValueError(f"a replay cannot filter by {', '.join(used)}")
    if postings.limit(2).count() != 1:
        raise ValueError("a replay has one posting")
    return postings


def land_raw(postings: DataFrame, path: str, run_id: str, fetched_at) -> DataFrame:
    """Appends postings as raw rows, before any identity work, and returns them as read back."""
    raw = postings.withColumns({"raw_id": derived_id(F.lit(run_id), F.col("seq"), F.lit("raw")), "fetched_at": F.lit(fetched_at).cast("timestamp"), "status": F.lit("fetched"), "run_id": F.lit(run_id)})
    raw.write.mode("append").parquet(path)
    return postings.sparkSession.read.parquet(path).filter(F.col("run_id") == run_id)


def create_only(df: DataFrame, path: str) -> None:
    """Writes JSON; an existing path is an error."""
    df.write.mode("errorifexists").json(path)
