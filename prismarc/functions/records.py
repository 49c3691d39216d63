"""Column functions on archive records: paths, licenses, rights, titles, categories."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import text as X


def slashed(c: Column) -> Column:
    """Lower case with forward slashes."""
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))


def has_marker(c: Column, markers: Sequence[str]) -> Column:
    """Whether a path holds one of the markers, whatever its case and slashes."""
    found = F.lit(False)
    for m in markers:
        found |= F.contains(slashed(c), F.lit(m.lower().replace("\\", "/")))
    return found


def local_asset(c: Column, suffixes: Sequence[str] = ("png", "jpg", "jpeg", "webp")) -> Column:
    """``c`` if it is a relative path that stays inside its root and has one of the suffixes, else null."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    bad = F.lower(path).rlike("^([a-z][a-z0-9+.-]*:|/|~)") | path.rlike(r"(^|/)\.\.(/|$)") | ~F.lower(path).rlike(rf"\.({'|'.join(suffixes)})$")
    return F.when(~bad, c)


def safe_resource(c: Column) -> Column:
    """``c`` if it is a relative path without traversal, empty parts or encoded separators, else null."""
    bad = c.rlike(r"(^|/)\.{1,2}(/|$)") | c.rlike(r"^/|//|\\|[\x00-\x1f]") | F.lower(c).rlike("%(2f|5c|2e|00)|^[a-z][a-z0-9+.-]*:")
    return F.when((c != "") & ~bad, c)


def license_record(reported: Column, detected: Column, fallback: Column, status: Column) -> Column:
    """What was reported and detected, what holds (detected, else reported, else the fallback) and its status."""
    reported, detected, fallback, status = (X.bounded(c, 160) for c in (reported, detected, fallback, status))
    holds = F.coalesce(detected, reported, fallback)
    return F.struct(reported.alias("reported"), detected.alias("detected"), holds.alias("effective"), F.coalesce(status, F.when(holds.isNotNull(), "reported").otherwise("not_verified")).alias("status"))


def public_title(title: Column, prompt: Column, style: Column) -> Column:
    """The title, or a neutral one where it is the prompt but for white space."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))
    return F.when(flat(title) == flat(prompt), F.concat(F.lit("Reference "), style)).otherwise(title)


def rights_status(restricted: Column, evidence_hash: Column, content_hash: Column) -> Column:
    """restricted, else verified where human evidence is bound to the content, else unverified."""
    return F.when(F.coalesce(restricted, F.lit(False)), "restricted").when(F.coalesce(evidence_hash == content_hash, F.lit(False)), "verified").otherwise("unverified")


#: Values of a batch that are Python objects at one time.
AT_ONCE = 64


def by_value(f: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    """A column function from one on single values, in Arrow batches, for what Spark has no expression for.

    Of a batch only ``AT_ONCE`` values at a time are Python objects, so a worker holds the batch and its results in Arrow.
    """
    to = to_arrow_type(StructType.fromDDL(f"v {kind}")["v"].dataType)

    def each(values: pa.Array) -> pa.Array:
        parts = [pa.array([f(v) for v in values.slice(at, AT_ONCE).to_pylist()], to) for at in range(0, len(values), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], to)

    return lambda c: F.arrow_udf(each, kind)(c)


#: The parts of a link: scheme, host (a name, or an address in brackets), port, path, query, fragment.  No user name fits.
LINK = r"^(?i)(https?)://(\[[0-9a-f:.]+\]|[^/?#@:\[\]%]+)(?::([0-9]{0,9}))?(/[^?#]*)?(\?[^#]*)?(?:#(.*))?$"
#: Last labels of names that lead nowhere outside.
INSIDE = ("internal", "local", "localhost")


def in_open_ranges(addresses: pd.Series) -> pd.Series:
    """Whether each is an address as it is written and outside of the reserved ranges, for which Spark has no expression."""

    def one(a: str | None) -> bool:
        try:
            return a is not None and ipaddress.ip_address(a).is_global
        except ValueError:
            return False

    return pd.Series([one(a) for a in addresses], dtype=bool)


def public_url(c: Column) -> Column:
    """A link that may be shown: http(s) to a public host, with its path and a plain fragment; else null.

    A host is a name of two labels or more that doesn't end inside, or an address in its usual form: what browsers would
    read as one (numbers only, octal, hex) isn't a name.
    """
    part = lambda i: F.regexp_extract(c, LINK, i)
    host, port, fragment = F.lower(part(2)), F.nullif(part(3), F.lit("")), part(6)
    labels = F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")
    address = F.startswith(host, F.lit("[")) | F.forall(labels, lambda l: l.rlike("^(0x[0-9a-f]+|[0-9]+)$"))
    plain = lambda l: (F.octet_length(l) <= 63) & l.rlike(r"^[\p{L}\p{N}]$|^[\p{L}\p{N}][\p{L}\p{N}\p{M}-]*[\p{L}\p{N}\p{M}]$")
    name = (F.size(labels) > 1) & F.forall(labels, plain) & ~F.element_at(labels, -1).isin(*INSIDE) & (F.array_join(labels, ".") != "localhost.localdomain")
    shown = F.when(address, F.pandas_udf(in_open_ranges, "boolean")(F.when(address, F.btrim(host, F.lit("[]"))))).otherwise(name)
    sound = (F.octet_length(c) > 0) & (F.char_length(c) <= 4096) & ~c.rlike(r"[\\\x00-\x1f\x7f]|(?U)\s") & c.rlike(LINK)
    sound &= F.coalesce(port.cast("long").between(1, 65535), F.lit(True))
    end = F.when(port.isNotNull(), F.concat(F.lit(":"), port.cast("long").cast("string"))).otherwise("")
    mark = F.when(fragment.rlike("^[A-Za-z0-9_-]{1,128}$"), F.concat(F.lit("#"), fragment)).otherwise("")
    return F.when(sound & shown, F.concat(F.lower(part(1)), F.lit("://"), host, end, part(4), mark))


def families(ids: Column) -> Column:
    """The parts of use-case ids before the first dot."""
    return F.array_distinct(F.transform(ids, lambda x: F.split_part(x, F.lit("."), F.lit(1))))


def browse_categories(ids: Column, contract: dict[str, Sequence[str]]) -> Column:
    """The categories of which a family is among those of the ids; 'unclassified' if there is none."""
    own = families(ids)
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, members))), F.lit(name)) for name, members in contract.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unclassified")))


def with_people(categories: Column, subject: Column, words: Sequence[str]) -> Column:
    """The categories and 'people' where the subject holds one of the words."""
    said = F.lower(F.coalesce(subject, F.lit("")))
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    return F.array_distinct(F.when(hit, F.array_append(categories, F.lit("people"))).otherwise(categories))


def record_time(run_id: Column, *keys: Column) -> Column:
    """The first key that begins as a date, else the date (eight digits) in the run's id."""
    dated = F.coalesce(*[F.when(k.rlike(r"^\d{4}-\d{2}-\d{2}"), k) for k in keys])
    digits = F.nullif(F.regexp_extract(run_id, r"(\d{8})", 1), F.lit(""))
    return F.coalesce(dated, F.concat_ws("-", F.substring(digits, 1, 4), F.when(digits.isNotNull(), F.substring(digits, 5, 2)), F.when(digits.isNotNull(), F.substring(digits, 7, 2))).alias("d"))


def distinct_folded(values: Column) -> Column:
    """Cleaned strings, of those that differ in case only the first."""
    clean = F.filter(F.transform(values, lambda v: X.bounded(v, 4000)), lambda v: v.isNotNull())
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def paid_or_locked(access: Column, *flags: Column) -> Column:
    found = F.lower(F.coalesce(access, F.lit(""))).isin("paid", "premium", "locked", "pro")
    for f in flags:
        found |= F.coalesce(f, F.lit(False))
    return found


def routed(task: Column, confidence: Column, people: Column, brands: Column, sensitive: Column, final: Column, sure: float = 0.92) -> Column:
    """Which tier of model takes a task: by class, down a tier if a first answer is sure, up for final decisions at risk."""
    risk = people | brands | sensitive
    usual = F.when(task.isin("extract", "tag"), "small").when(task.isin("caption", "classify"), "medium").otherwise("large")
    return F.when(final & risk, "human").when(final, "large").when((confidence >= sure) & ~sensitive, "small").otherwise(usual)
