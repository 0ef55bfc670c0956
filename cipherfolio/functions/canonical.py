"""Canonical spellings: params, curves, versions, locators, suites.

Every function takes and returns a Column, so the whole module stays inside
the JVM and fuses into whatever projection uses it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Curve spellings and the one name each stands for.
CURVE_ALIASES = {
    "prime256v1": "P-256",
    "secp256r1": "P-256",
    "p256": "P-256",
    "p-256": "P-256",
    "nistp256": "P-256",
    "secp384r1": "P-384",
    "prime384v1": "P-384",
    "p384": "P-384",
    "p-384": "P-384",
    "nistp384": "P-384",
    "secp521r1": "P-521",
    "p521": "P-521",
    "p-521": "P-521",
    "nistp521": "P-521",
    "secp256k1": "secp256k1",
    "curve25519": "X25519",
    "x25519": "X25519",
    "ed25519": "Ed25519",
    "curve448": "X448",
    "x448": "X448",
    "ed448": "Ed448",
}
# Accepted spellings of a yes and of a no.
TRUE_WORDS = ("true", "yes", "1", "on")
FALSE_WORDS = ("false", "no", "0", "off")
# Protocol versions, oldest first.
TLS_ORDER = ("SSLv2", "SSLv3", "TLSv1", "TLSv1.1", "TLSv1.2", "TLSv1.3")
# Substrings that mark a post-quantum key exchange group.
PQ_MARKERS = ("MLKEM", "ML-KEM", "KYBER", "FRODO", "BIKE", "HQC")

BLANKS = " \t\n\r\x0b\x0c"


def literal_map(table: dict[str, object]) -> Column:
    """A small constant lookup table; Catalyst folds it to one map literal."""
    if all(isinstance(value, str) for value in table.values()):
        packed = "\x1e".join(f"{key}\x1f{value}" for key, value in table.items())
        return F.str_to_map(F.lit(packed), F.lit("\x1e"), F.lit("\x1f"))
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def literal_words(words: Sequence[str]) -> Column:
    """A constant list of words, folded to one array literal."""
    return F.split(F.lit("\x1e".join(words)), "\x1e")


def lookup(table: dict[str, object], key: Column) -> Column:
    """``table[key]``, NULL on a miss."""
    return F.try_element_at(literal_map(table), key)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def to_integer_text(value: Column) -> Column:
    text = strip(value)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint").cast("string"))


def to_upper_text(value: Column) -> Column:
    text = strip(value)
    return F.when(text != "", F.upper(text))


def to_boolean_text(value: Column) -> Column:
    text = F.lower(strip(value))
    return (
        F.when(text.isin(*TRUE_WORDS), F.lit("true"))
        .when(text.isin(*FALSE_WORDS), F.lit("false"))
    )


def to_date_text(value: Column) -> Column:
    text = strip(value)
    dashed = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    iso = F.coalesce(dashed, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text))
    return F.date_format(iso.try_cast("date"), "yyyy-MM-dd")


def to_curve_name(value: Column) -> Column:
    return lookup(CURVE_ALIASES, F.lower(strip(value)))


def to_protocol_version(value: Column) -> Column:
    """``TLSv1_2``, ``tlsv1.2``, ``TLS1.2`` -> ``TLSv1.2``; NULL if not a protocol version."""
    text = strip(value)
    shape = r"(?i)^(TLS|SSL)V?(\d+)(?:[._](\d+))?$"
    family = F.upper(F.regexp_extract(text, shape, 1))
    major = F.regexp_extract(text, shape, 2)
    minor = F.regexp_extract(text, shape, 3)
    return F.when(
        text.rlike(shape),
        F.concat(family, F.lit("v"), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(F.lit(""))),
    )


#: Param name -> coercion. A value that does not fit keeps its spelling.
PARAM_COERCIONS = {
    "key_size": to_integer_text,
    "mode": to_upper_text,
    "curve": to_curve_name,
    "version": to_protocol_version,
    "valid_to": to_date_text,
    "valid_from": to_date_text,
    "hybrid": to_boolean_text,
    "pqc_capable": to_boolean_text,
    "flagged": to_boolean_text,
    "version_is_range": to_boolean_text,
}


def canonical_params(params: Column) -> Column:
    """Known params in canonical form, everything else as written. Idempotent."""

    by_rule: dict[object, list[str]] = {}
    for name, rule in PARAM_COERCIONS.items():
        by_rule.setdefault(rule, []).append(name)

    def coerce(key: Column, value: Column) -> Column:
        chain = F
        for rule, names in by_rule.items():
            chain = chain.when(key.isin(*names), rule(value))
        return F.coalesce(chain, value)

    return F.transform_values(params, coerce)


def sorted_entries(params: Column) -> Column:
    """Map entries as a key-ordered array: comparable, groupable and hashable."""
    return F.sort_array(F.map_entries(params))


def drop_position(view: Column, locator: Column) -> Column:
    """Remove the line, offset or pid: what is left names the artefact."""
    return F.when(view == "observed", F.regexp_replace(locator, r":pid[0-9]+$", "")).otherwise(
        F.regexp_replace(locator, r":[0-9]+$", "")
    )


def relative_to_target(path: Column, kind: Column, ref: Column) -> Column:
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    root = F.regexp_replace(F.replace(ref, F.lit("\\"), F.lit("/")), r"/+$", "")
    inside = kind.isin("repo", "directory") & (root != "") & F.startswith(slashed, F.concat(root, F.lit("/")))
    return F.when(F.coalesce(inside, F.lit(False)), F.substr(slashed, F.length(root) + 2)).otherwise(slashed)


def normalise_locator(view: Column, locator: Column, kind: Column | None = None, ref: Column | None = None) -> Column:
    kind = F.lit(None).cast("string") if kind is None else kind
    ref = F.lit(None).cast("string") if ref is None else ref
    return relative_to_target(drop_position(view, locator), kind, ref)


def split_locator(view: Column, locator: Column) -> tuple[Column, Column]:
    """``(location, line)``; observed locators are addresses and stay whole."""
    positional = (view != "observed") & locator.rlike(r"(?s)^.+:[0-9]+$")
    location = F.when(positional, F.regexp_replace(locator, r":[0-9]+$", "")).otherwise(locator)
    line = F.when(positional, F.regexp_extract(locator, r":([0-9]+)$", 1).try_cast("bigint"))
    return location, line


def is_hybrid(params: Column, name: Column) -> Column:
    """A stated flag wins in both directions; the name is only a fallback."""
    stated = F.lower(F.try_element_at(params, F.lit("hybrid")))
    group = F.coalesce(F.try_element_at(params, F.lit("group")), F.lit(""))
    label = F.upper(F.concat_ws(" ", group, name))
    return (
        F.when(stated == "true", F.lit(True))
        .when(stated == "false", F.lit(False))
        .otherwise(label.rlike("|".join(PQ_MARKERS)))
    )


def tls_rank(version: Column) -> Column:
    """Position in ``TLS_ORDER`` from 0, NULL for a version nobody ranks."""
    spelled = F.lower(F.replace(F.replace(strip(version), F.lit("TLS "), F.lit("TLSv")), F.lit("_"), F.lit(".")))
    return lookup({name.lower(): rank for rank, name in enumerate(TLS_ORDER)}, spelled)


def lowest_tls_version(versions: Column) -> Column:
    """The lowest known version listed, else the first one listed."""
    known = F.array(*[F.lit(name) for name in TLS_ORDER])
    return F.coalesce(F.get(F.array_intersect(known, versions), F.lit(0)), F.get(versions, F.lit(0)))


# Group names and the spelling the TLS library reports for each.
GROUP_SPELLINGS = {
    "P-256": "prime256v1",
    "P-384": "secp384r1",
    "P-521": "secp521r1",
    "X25519": "x25519",
    "X448": "x448",
}


def canonical_group(group: Column) -> Column:
    text = strip(group)
    return F.coalesce(lookup(GROUP_SPELLINGS, F.upper(text)), text)


# Suite name fragments, first match decides.
SUITE_PRIMITIVES = (
    ("CHACHA20", "stream-cipher"),
    ("AES", "block-cipher"),
    ("CAMELLIA", "block-cipher"),
    ("ARIA", "block-cipher"),
    ("3DES", "block-cipher"),
    ("DES", "block-cipher"),
    ("RC4", "stream-cipher"),
    ("NULL", "unknown"),
)


def suite_primitive(suite: Column) -> Column:
    upper = F.upper(suite)
    chain = F
    for fragment, primitive in SUITE_PRIMITIVES:
        chain = chain.when(F.contains(upper, F.lit(fragment)), F.lit(primitive))
    return chain.otherwise(F.lit("unknown"))
