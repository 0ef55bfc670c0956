"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the visible text under character n-gram models, the language
the markup declares, the address suffix, and what is known of the host. The models are fitted on a bounded sample of
labelled documents. Everything about hosts, suffixes and declarations is counted over all pages: a page's text gives it
fractions of each language, grouped sums of them per host are smoothed by the sums of its domain, those by its address
suffix, and those by the whole web. A page's own fractions are taken out of the sums it is judged by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable

#: Documented bound of the fitted sample: documents of each language, by a hash of the id.
ROWS_PER_LANGUAGE = 400
BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
#: A page's n-grams overlap and repeat; their joint evidence counts as that of so many independent ones at most.
INDEPENDENT = 40.0
#: Strength, in pages, of the level above in the hierarchy of priors; of one declaration; least chance of any text.
UPPER_PAGES = 5.0
DECLARED_PAGES = 1.0
MOST_REMEMBERED = 300_000
INVISIBLE = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
DECLARED_META = re.compile(r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b")
NONE, OTHER = "none", "other"


@dataclass(frozen=True)
class TextModel:
    """Languages in order, and the log chance of each n-gram bucket per language."""

    languages: list[str]
    chances: np.ndarray


def visible(html: str | None) -> str:
    return unescape(INVISIBLE.sub(" ", html)) if html else ""


def declared_in(html: str | None) -> str:
    found = (DECLARED.search(html) or DECLARED_META.search(html)) if html else None
    return found[1].lower() if found else NONE


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty where it has none. A host is lower case, without ``www.``; a domain
    is its last two labels."""
    try:
        host = (urlsplit(url.strip()).hostname or "") if url else ""
    except ValueError:
        host = ""
    host = host.lower().removeprefix("www.")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def word_buckets(word: str) -> list[int]:
    marked = f" {word} "
    return [crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


def text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> TextModel:
    """Fitted on at most ``per_language`` whole documents of each labelled language. Documents without an id are not drawn."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(row[0] for row in labelled.select(F.lower(lang_col)).distinct().collect())
    counts = np.full((BUCKETS, max(len(languages), 1)), 0.05)
    for number, language in enumerate(languages):
        own = labelled.filter((F.lower(lang_col) == language) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(text_col).alias("text"))
        # Ids are drawn first, so that no task sends texts which are then not taken.
        drawn = own.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(per_language)
        rows = own.join(F.broadcast(drawn), "_key").orderBy(F.xxhash64("_key"), "_key", "text").limit(per_language)
        words = Counter(word for row in rows.collect() for word in row["text"].lower().split())
        for word, times in words.items():
            np.add.at(counts[:, number], word_buckets(word), times)
    return TextModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


class WordChances(dict):
    """Word -> row of sums of log chances per language; the last column counts n-grams."""

    def __init__(self, chances: np.ndarray) -> None:
        super().__init__()
        self.chances = chances
        self.table = np.zeros((1 << 14, chances.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        found = word_buckets(word)
        self.table[number, :-1] = self.chances[found].sum(axis=0)
        self.table[number, -1] = len(found)
        self[word] = number
        return number

    def evidence(self, text: str) -> np.ndarray:
        """Log likelihood per language, as of ``INDEPENDENT`` n-grams at most; zeros for a text without words."""
        words = text.lower().split()
        if not words:
            return np.zeros(self.chances.shape[1])
        if len(self) > MOST_REMEMBERED:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sums = self.table[numbers].sum(axis=0)
        logs = sums[:-1] * min(1.0, INDEPENDENT / sums[-1])
        return logs - logs.max()


def read_pages(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, host, domain, suffix, declared, text): text is the log likelihood per language. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = source.schema["page"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chances = WordChances(model.chances)
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = html.as_py()
                said = declared_in(page)
                rows.append((*address(url), said if said in model.languages or said == NONE else OTHER, chances.evidence(visible(page)).tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.float64()))], ["page", "host", "domain", "suffix", "declared", "text"])

    return source.mapInArrow(read, f"page {kind}, host string, domain string, suffix string, declared string, text array<double>")


def normal(logs: Column) -> Column:
    """Chances that sum to one, of an array of logs."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def sums_by(rows: DataFrame, keys: list[str], languages: int, out: str) -> DataFrame:
    """Per key the summed fractions of each language, as an array; summed map-side, so a hot host is no single task."""
    sums = [F.sum(F.get("own", F.lit(i))).alias(f"_s{i}") for i in range(languages)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"_s{i}" for i in range(languages)]).alias(out))


def smoothed(counts: Column, upper: Column, own: Column) -> Column:
    """Counts without the page's own share, filled up with ``UPPER_PAGES`` pages of the level above."""
    rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(rest, upper, lambda c, u: (c + UPPER_PAGES * u) / (total + UPPER_PAGES))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, ``host``, ``declared``, ``text_lang``, ``lang``, ``chance`` and ``chances`` (by language).

    Defined cases: a null or empty page, or one without visible words, is judged by its host and declaration alone; a
    null or odd address belongs to the empty host, and then to all pages; a declaration that is missing or no known
    language is evidence of its own kind, weighed as all pages have it. Ties go to the first language by name. Null and
    repeated ids are judged row by row. An empty table gives no rows, and a model without languages gives null.
    """
    n = len(model.languages)
    if not n:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col(id_col), nothing.alias("host"), nothing.alias("declared"), nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("chance"), F.lit(None).cast("array<double>").alias("chances"))
    read = durable(read_pages(pages, model, id_col, url_col, html_col).withColumn("own", normal(F.col("text"))))
    everywhere = F.lit(1.0 / n)
    flat = F.array(*[everywhere] * n)
    whole = sums_by(read, [], n, "whole_sum").first()
    whole_sum = F.array(*[F.lit(float(x or 0.0)) for x in (whole[0] if whole and whole[0] else [0.0] * n)])
    suffixes, domains, hosts = (sums_by(read, [key], n, f"{key}_sum") for key in ("suffix", "domain", "host"))
    places = read.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("pages"))
    known = durable(places.join(hosts, "host").join(domains, "domain").join(suffixes, "suffix").select("host", "host_sum", "domain_sum", "suffix_sum"))
    # at most (languages) x (languages + 2) numbers
    said = {(row[0]): row[1:] for row in read.groupBy("declared").agg(*[F.sum(F.get("own", F.lit(i))) for i in range(n)]).limit(n + 2).collect()}
    kinds = [*model.languages, OTHER, NONE]
    table = np.array([[float(x or 0.0) for x in said.get(kind, [0.0] * n)] for kind in kinds]) + DECLARED_PAGES / len(kinds)
    logs = np.log(table / table.sum(axis=0))
    declared = F.create_map(*[x for kind, row in zip(kinds, logs, strict=True) for x in (F.lit(kind), F.array(*[F.lit(float(v)) for v in row]))])

    met = read.join(known, "host")
    prior = smoothed(F.col("host_sum"), smoothed(F.col("domain_sum"), smoothed(F.col("suffix_sum"), smoothed(whole_sum, flat, F.col("own")), F.col("own")), F.col("own")), F.col("own"))
    fused = met.withColumn("prior", prior).withColumn("logs", F.zip_with(F.zip_with("text", "prior", lambda t, p: t + F.log(p)), F.element_at(declared, F.col("declared")), lambda a, b: a + b))
    chances = fused.withColumn("chances", normal(F.col("logs")))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    return chances.select(F.col("page").alias(id_col), "host", "declared", best(F.col("text")).alias("text_lang"), best(F.col("chances")).alias("lang"), F.array_max("chances").alias("chance"), "chances")
