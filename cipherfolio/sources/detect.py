"""Detection rules over lines of text.

A rule is data: a pattern for one line, what it is evidence of, and which
groups carry parameters. All rules of a language become one projection over
the lines table, so detection never shuffles. Call sites that span lines and
values that flow through variables are out of its reach; rules that would need
them are written as single-line shapes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio import schema as S
from cipherfolio.functions import redact as R
from cipherfolio.knowledge import HERE, KnowledgeError, read_table
from cipherfolio.operators.durable import durable
from cipherfolio.sources import files as T

# Confidence of an unresolved parameter, symbol params, prefixes.
UNRESOLVED = 0.6
SYMBOL_PARAMS = frozenset({"mode", "curve", "version"})
SYMBOL_PREFIX = r"^(?:MODE_|PROTOCOL_)"
HOLDER = "holder"
LANGUAGES = {".py": "python", ".go": "go", ".java": "java", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript"}


@dataclass(frozen=True)
class DetectRule:
    id: str
    language: str
    pattern: str
    algorithm: str
    primitive: str
    usage: str
    note: str
    asset_type: str = "algorithm"
    capture: dict[str, int] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    mode_flags: tuple[str, ...] = ()
    confidence: float | None = None
    redact: bool = False
    annotates: str | None = None
    usage_refinable: bool = False
    min_entropy: float | None = None
    literal_group: int = 0

    def __post_init__(self) -> None:
        def refuse(why: str) -> None:
            raise KnowledgeError(f"detection rule {self.id!r}: {why}")

        for name in ("algorithm", "primitive", "usage", "note", "pattern"):
            if not getattr(self, name):
                refuse(f"{name} is required")
        if self.primitive not in S.PRIMITIVES or self.usage not in S.USAGES or self.asset_type not in S.ASSET_TYPES:
            refuse("a value is outside its vocabulary")
        if self.confidence is not None and not 0 < self.confidence <= 1:
            refuse("confidence is a probability in (0, 1]")
        if "candidate" in self.flags and (self.confidence is None or self.confidence >= 1):
            refuse("a candidate declares a confidence below 1")
        if self.annotates not in (None, "usage", "configurable"):
            refuse("annotates usage or configurable")


def load_rules(folder: Path | str = HERE / "detect") -> list[DetectRule]:
    rules = []
    for path in sorted(Path(folder).glob("*.toml")):
        for raw in read_table(path)["rules"]:
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
            rules.append(DetectRule(language=path.stem, **known))
    if len({r.id for r in rules}) != len(rules):
        raise KnowledgeError("a detection rule id is used twice")
    return rules


def language_of(path: Column) -> Column:
    chain = F
    for suffix, language in LANGUAGES.items():
        chain = chain.when(path.endswith(suffix), F.lit(language))
    return chain


# --- captured values --------------------------------------------------------

QUOTED_LITERAL = r"^[rRbBuU]{0,2}(?:\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|`[^`]*+`)$"
NUMBER_LITERAL = r"^[+-]?(?:0[xX][0-9A-Fa-f]+|[0-9][0-9_]*(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)$"
WORD_LITERAL = r"^(?:True|False|None|true|false|null)$"


def is_literal(text: Column) -> Column:
    return text.rlike(QUOTED_LITERAL) | text.rlike(NUMBER_LITERAL) | text.rlike(WORD_LITERAL)


def is_resolved(text: Column) -> Column:
    """Whether a captured value is pinned where it is written.

    Literals, calls, attribute references and ALL_CAPS names are; a plain
    lower-case name is the shape of a value read at run time.
    """
    constant = text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & (text == F.upper(text))
    return is_literal(text) | F.contains(text, F.lit("(")) | F.contains(text, F.lit(".")) | constant


def unquote(text: Column) -> Column:
    return F.when(text.rlike(QUOTED_LITERAL), F.regexp_replace(F.regexp_replace(text, r"^[rRbBuU]{0,2}[\"'`]", ""), r"[\"'`]$", "")).otherwise(text)


def as_symbol(text: Column) -> Column:
    tail = F.substring_index(F.trim(F.substring_index(text, "(", 1)), ".", -1)
    return F.when(text.rlike(QUOTED_LITERAL), unquote(text)).otherwise(F.regexp_replace(tail, SYMBOL_PREFIX, ""))


def param_value(name: Column, text: Column) -> Column:
    plain = F.when(text.rlike(r"^[0-9][0-9_]*$"), F.replace(text, F.lit("_"), F.lit(""))).otherwise(unquote(text))
    return F.when(name.isin(*SYMBOL_PARAMS), as_symbol(text)).otherwise(plain)


# --- matching ---------------------------------------------------------------

RULE_COLUMNS = (
    "rule_no int, rule_id string, pattern string, algorithm string, primitive string, usage string, asset_type string, "
    "captures array<struct<name:string,at:int>>, holder_at int, fixed map<string,string>, mode_flags array<string>, ceiling double, "
    "redact boolean, annotates string, usage_refinable boolean, min_entropy double, literal_at int"
)


def rule_table(spark: SparkSession, rules: Sequence[DetectRule]) -> DataFrame:
    """The attributes of every rule: one row per rule of the knowledge files."""
    rows = []
    for number, rule in enumerate(rules):
        fixed = dict(rule.fixed)
        if "critical" in rule.flags:
            fixed["flagged"] = "true"
        if "candidate" in rule.flags:
            fixed["candidate"] = "true"
        captures = [(name, at) for name, at in sorted(rule.capture.items()) if name != HOLDER]
        rows.append((
            number, rule.id, rule.pattern, rule.algorithm, rule.primitive, rule.usage, rule.asset_type, captures, rule.capture.get(HOLDER, 0),
            fixed, list(rule.mode_flags), rule.confidence or 1.0, rule.redact, rule.annotates, rule.usage_refinable, rule.min_entropy, rule.literal_group))
    return spark.createDataFrame(rows, RULE_COLUMNS)


def _extract(pattern_at: Column) -> Column:
    return F.trim(F.call_function("regexp_extract", F.col("match"), F.col("pattern"), pattern_at))


def matches(lines: DataFrame, rules: Sequence[DetectRule] | None = None) -> DataFrame:
    """Every rule match on every line (scan_id, system, path, language, line_no, line).

    Lines no rule of their language can match are dropped by one alternation
    before any per-rule work; only actual matches meet the rule attributes.
    """
    rules = load_rules() if rules is None else rules
    by_language: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        by_language.setdefault(rule.language, []).append(number)
    text, language = F.col("line"), F.col("language")
    worth, found = F, F
    for name, own in by_language.items():
        worth = worth.when(language == name, text.rlike("|".join(f"(?:{rules[n].pattern})" for n in own)))
        hits = [
            F.when(text.rlike(rules[n].pattern), F.struct(F.lit(n).alias("rule_no"), F.regexp_extract_all(text, F.lit(f"({rules[n].pattern})"), F.lit(1)).alias("found")))
            for n in own
        ]
        found = found.when(language == name, F.array_compact(F.array(*hits)))
    keep = lines.columns
    hit = (
        lines.filter(worth).select(*keep, F.explode(found).alias("h"))
        .select(*keep, "h.rule_no", F.explode("h.found").alias("match"))
        .join(rule_table(lines.sparkSession, rules), "rule_no")
    )
    strong = F.col("min_entropy").isNull() | (R.entropy(unquote(_extract(F.col("literal_at")))) >= F.col("min_entropy"))
    taken = F.transform("captures", lambda c: F.struct(c["name"].alias("name"), _extract(c["at"]).alias("text")))
    staged = hit.filter(strong).withColumn("taken", taken).withColumn("resolved", F.forall("taken", lambda t: is_resolved(t["text"])))
    captured = F.map_from_entries(F.transform("taken", lambda t: F.struct(t["name"], param_value(t["name"], t["text"]))))
    staged = staged.withColumn("params", F.map_concat("fixed", captured))
    weak_mode = F.coalesce(F.array_contains("mode_flags", F.try_element_at("params", F.lit("mode"))), F.lit(False))
    flagged = F.when(weak_mode & F.try_element_at("params", F.lit("flagged")).isNull(), F.create_map(F.lit("flagged"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    holder = F.when(F.col("holder_at") > 0, _extract(F.col("holder_at")))
    return staged.select(
        *keep, "rule_id", "algorithm", "primitive", "usage", "asset_type", F.map_concat("params", flagged).alias("params"), "resolved",
        F.least(F.when(F.col("resolved"), F.lit(1.0)).otherwise(F.lit(UNRESOLVED)), F.col("ceiling")).alias("confidence"),
        "redact", "annotates", "usage_refinable",
        F.when(holder.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*$"), holder).alias("holder"))


def annotate(found: DataFrame) -> DataFrame:
    """Apply annotations to detections at the same (path, line).

    An annotation never becomes a finding. The usage of the first rule id
    replaces an unknown or refinable usage; a configurability annotation makes
    the value configurable and certain.
    """
    site = ["scan_id", "system", "path", "line_no"]
    notes = found.filter(F.col("annotates").isNotNull()).groupBy(*site).agg(
        F.min(F.when(F.col("annotates") == "usage", F.struct("rule_id", "usage"))).alias("refined"),
        F.bool_or(F.col("annotates") == "configurable").alias("from_config"))
    plain = found.filter(F.col("annotates").isNull())
    joined = plain.join(notes, site, "left")
    may = (F.col("usage") == "unknown") | F.col("usage_refinable")
    from_config = F.coalesce("from_config", F.lit(False))
    return (
        joined.withColumn("usage", F.when(may & F.col("refined").isNotNull(), F.col("refined.usage")).otherwise(F.col("usage")))
        .withColumn("configurable", from_config | ~F.col("resolved"))
        .withColumn("confidence", F.when(from_config, F.lit(1.0)).otherwise(F.col("confidence")))
        .drop("refined", "from_config", "annotates", "usage_refinable", "resolved")
    )


def fold_candidates(detections: DataFrame) -> DataFrame:
    """Fold each candidate into the confirmed detections with its holder.

    A candidate whose holder also has a confirmed detection in its file is not
    a finding of its own: its line becomes one more sighting (``also``) of every
    confirmed detection of the holder, which keeps its own confidence and
    configurability. A candidate nothing confirms stays as it is. ``also`` is
    bounded by the candidate lines of one holder in one file.
    """
    key = ["scan_id", "system", "path", "holder"]
    is_candidate = F.coalesce(F.try_element_at("params", F.lit("candidate")) == "true", F.lit(False))
    marked = detections.withColumn("_candidate", is_candidate)
    candidates = marked.filter("_candidate").drop("_candidate")
    confirmed = marked.filter("NOT _candidate").drop("_candidate")
    named = confirmed.filter("holder IS NOT NULL").select(*key).distinct()
    sighting = F.struct("line_no", "rule_id", "line", "redact")
    lines = candidates.join(named, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set(sighting)).alias("also"))
    kept = confirmed.join(lines, key, "left")
    alone = candidates.join(named, key, "left_anti").withColumn("also", F.lit(None).cast(kept.schema["also"].dataType))
    return kept.unionByName(alone.select(*kept.columns))


def detection_findings(detections: DataFrame) -> DataFrame:
    """Findings of detections; folded candidates are further occurrences after the detection's own line."""
    def place(number: Column, rule: Column, line: Column, redact: Column) -> Column:
        snippet = R.scrub_line(line, redact)
        return F.struct(
            F.lit("declared").alias("view"), F.concat_ws(":", "path", number.cast("string")).alias("locator"), F.concat(F.lit("rule="), rule).alias("detail"),
            F.when(snippet != "", snippet).alias("snippet"))

    own = F.array(place(F.col("line_no"), F.col("rule_id"), F.col("line"), F.col("redact")))
    rows = detections.withColumn("places", own)
    if "also" in detections.columns:
        more = F.transform("also", lambda a: place(a["line_no"], a["rule_id"], a["line"], a["redact"]))
        rows = rows.withColumn("places", F.when(F.col("also").isNull(), own).otherwise(F.array_distinct(F.concat(own, more))))
    shaped = T.finding(
        scanner_id=F.lit("source"), view=F.lit("declared"), asset_type=F.col("asset_type"), primitive=F.col("primitive"), algorithm=F.col("algorithm"),
        params=F.col("params"), usage=F.col("usage"), configurable=F.col("configurable"), confidence=F.col("confidence"),
        locator=F.lit(""), detail=F.lit(""))
    return rows.select(*shaped, "places").withColumn("occurrences", F.col("places")).drop("places")


def source_findings(files: DataFrame, rules: Sequence[DetectRule] | None = None) -> DataFrame:
    """Text files (scan_id, system, path, text) -> declared findings."""
    rows = T.lines(files.withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL"))
    # Annotation and folding read the matches several times; the rules run once.
    return detection_findings(fold_candidates(annotate(durable(matches(rows, rules)))))
