"""Normal forms of text, near scores, JSON shapes and tiers, argument and fence parsing.

Unicode normal forms, case folding, BLAKE2b, strict JSON and spans have no
expression in Spark; those run in Arrow batches, the rest in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid

import numpy as np

try:  # on short values twice as fast as hashlib's
    from _md5 import md5
except ImportError:
    from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .records import by_value


def _lines(value: str | None) -> str:
    lines = [" ".join(re.split("[ \t]+", x)).strip() for x in re.split("\r\n|\r|\n", unicodedata.normalize("NFKC", value or ""))]
    return "\n".join(x for i, x in enumerate(lines) if x or (i and lines[i - 1])).strip()


def _term(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", value or "").casefold().split())


def _prompt(value: str | None) -> str:
    return re.sub(r"\s+", " ", value or "").strip().casefold()


def _gallery(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", value or "").lower().split())


#: Forms by name, for their digests.
FORMS = {"prompt": _prompt, "term": _term, "gallery": _gallery}


def form_digest(name: str, c: Column) -> Column:
    """SHA-256 of the form in hex, taken where the form is made: no text goes back from Python."""
    form = FORMS[name]
    return by_value(lambda v: hashlib.sha256(form(v).encode()).hexdigest(), "string")(c)


def normal_text(c: Column) -> Column:
    """NFKC, line feeds, single blanks in lines, single blank lines."""
    return by_value(_lines, "string")(c)


def normal_term(c: Column) -> Column:
    """NFKC, case folded, single spaces."""
    return by_value(_term, "string")(c)


def normal_prompt(c: Column) -> Column:
    """Single spaces, case folded, no other normal form."""
    return by_value(_prompt, "string")(c)


def normal_gallery(c: Column) -> Column:
    """NFKC, lower case (of Korean, which is that of the root locale), single spaces."""
    return by_value(_gallery, "string")(c)


#: Runs of Latin letters and digits, Hangul, Chinese characters, kana.
#: The scripts whose runs are tokens.
SCRIPTS = "([a-z0-9]+|[가-힣]+|[㐀-鿿]+|[぀-ヿ]+)"


def script_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(SCRIPTS), 1)


def jaccard_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(X.jaccard(a, b), F.lit(0.0))


def joined(tokens: Column) -> Column:
    """Tokens as one string with a zero between two; null without tokens.  Arrays of strings cost many times as much on the way to Python."""
    return F.when(F.size(tokens) > 0, F.array_join(tokens, "\0"))


def ones(digests: list[bytes]) -> np.ndarray:
    """How many of the digests have each of their first 64 bits."""
    first = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)[:, :8]
    return np.unpackbits(np.ascontiguousarray(first), axis=1).sum(axis=0, dtype=np.int64)


#: Bytes of UTF-8 that aren't Latin letters or digits, as blanks; texts whose tokens such bytes can have.
_LATIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_WIDE = re.compile("[가-힣㐀-鿿぀-ヿ]")
#: Windows that are digested at once.
WINDOWS = 4096


def latin_list(value: str | None) -> list[bytes]:
    """Runs of Latin letters and digits in lower case, in UTF-8."""
    return (value or "").lower().encode().translate(_LATIN).split()


def script_list(value: str) -> list[bytes]:
    """The tokens of ``script_tokens``, in UTF-8."""
    low = value.lower()
    return [x.encode() for x in re.findall(SCRIPTS, low)] if _WIDE.search(low) else low.encode().translate(_LATIN).split()


def window_ones(tokens: list[bytes], width: int, digest) -> tuple[np.ndarray, int]:
    """How many of the digests of all windows of ``width`` tokens (of fewer tokens each is one) have each bit, and how many windows there are."""
    width = width if len(tokens) >= width else 1
    many, sums = len(tokens) - width + 1, np.zeros(64, np.int64)
    for at in range(0, many, WINDOWS):
        part = tokens[at : at + WINDOWS + width - 1]
        sums += ones([digest(w) for w in map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))])
    return sums, many


def _signed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _blake(value: bytes) -> bytes:
    return hashlib.blake2b(value, digest_size=8).digest()


def _md5(value: bytes) -> bytes:
    return md5(value).digest()


def majority(tokens: list[bytes]) -> int:
    """The bits that at least half of the digests of all windows of three tokens have (of one token, in shorter lists); 0 without tokens."""
    if not tokens:
        return 0
    sums, many = window_ones(tokens, 3, _blake)
    return _signed(2 * sums >= many)


def simhash(tokens: Column) -> Column:
    """64 bits by the majority over word trigrams (words, where there are fewer than three), as a long."""
    return by_value(lambda v: majority([] if v is None else v.encode().split(b"\0")), "long")(joined(tokens))


def script_simhash(c: Column) -> Column:
    """``simhash`` of the script tokens of the normal text: tokens stay where they are cut."""
    return by_value(lambda v: majority(script_list(_lines(v))), "long")(c)


def _most(tokens: list[bytes], width: int) -> int | None:
    if not tokens:
        return None
    sums, many = window_ones(tokens, width, _md5)
    return _signed(2 * sums > many)


def majority_bits(tokens: Column, width: int = 3) -> Column:
    """64 bits as a long: those that more than half of the digests (MD5, the first half) of all windows of ``width`` tokens have.

    Of fewer tokens each is a window; null without tokens.
    """
    return by_value(lambda v: None if v is None else _most(v.encode().split(b"\0"), width), "long")(joined(tokens))


def latin_majority_bits(c: Column, width: int = 3) -> Column:
    """``majority_bits`` of the Latin tokens of text: tokens stay where they are cut."""
    return by_value(lambda v: _most(latin_list(v), width), "long")(c)


def token_set(value: str | None) -> dict | None:
    """Of the normal text: its length, its distinct script tokens in order (NUL between), their number, its fingerprint and a hash of these; None without tokens."""
    said = _lines(value)
    tokens = script_list(said)
    if not tokens:
        return None
    own, bits = sorted(set(tokens)), majority(tokens)
    held = b"\0".join(own)
    node = int.from_bytes(_blake(b"%d %d " % (len(said), bits) + held), "big", signed=True)
    return {"node": node, "chars": len(said), "size": len(own), "print": bits, "own": held}


def token_sets(c: Column) -> Column:
    return by_value(token_set, "struct<node:long,chars:int,size:int,print:long,own:binary>")(c)


def hamming(a: Column, b: Column) -> Column:
    """Of longs; null if either is missing."""
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def hex_bits(c: Column) -> Column:
    """A long from 16 hex digits; null for null and for the empty string."""
    return F.conv(F.nullif(c, F.lit("")), 16, -10).cast("long")


def share(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def near_score(chars: tuple[Column, Column], sizes: tuple[Column, Column], prints: tuple[Column, Column], met: Column) -> Column:
    """Null unless lengths, token counts, fingerprints and token sets (``met``: tokens in both) are all close; then their weighted mean."""
    length, count, bits = share(*chars), share(*sizes), hamming(*prints)
    overlap = met / (sizes[0] + sizes[1] - met)
    gates = (F.least(*chars) > 0) & (length >= 0.9) & (count >= 0.88) & (bits <= 12) & (overlap >= 0.88)
    return F.when(gates, F.round(overlap * 0.75 + length * 0.2 + (64 - bits) / 64 * 0.05, 6))


#: Fixed values (numbers by ASCII digits, as Java's patterns take them): brackets, braces, angle brackets, quotes, numbers.
SLOTS = (r"\[[^\]\n]{1,80}\]", r"\{[^}\n]{1,80}\}", r"<[^>\n]{1,80}>", "(?:\"[^\"\n]{1,120}\"|'[^'\n]{1,120}')", r"\b[0-9]+(?:[.:/-][0-9]+)*\b")


def slotted(c: Column) -> Column:
    """Slots and numbers of lower-cased text as <var>, single spaces."""
    c = F.lower(c)
    for slot in SLOTS:
        c = F.regexp_replace(c, slot, " <var> ")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def template_signature(c: Column, least: int = 8, most: int = 160) -> Column:
    """The first tokens of a template with at least one slot and ``least`` tokens, repeats in a row once; else null."""
    masked = F.regexp_replace(F.lower(c), r"https?://[^ \t\n\r]+", " <var> ")
    tokens = F.regexp_extract_all(slotted(masked), F.lit("(<var>|[a-z0-9]+|[가-힣]+)"), 1)

    def signed(own: Column) -> Column:
        runs = F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1)))
        return F.when((F.size(own) >= least) & F.array_contains(own, "<var>"), F.array_join(F.slice(runs, 1, most), " "))

    # bound to a name of a lambda: else the expressions of the tokens run again for each token
    return F.get(F.transform(F.array(tokens), signed), 0)


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key twice")
    return dict(pairs)


def _refused(name: str) -> None:
    raise ValueError(name)


def json_shape(value: str | None) -> dict | None:
    """containers, scalars, named leaves and non-empty named strings of strict JSON (fences stripped, no key twice, no NaN); None if it isn't."""
    raw = re.sub(r"^\s*```(?:json)?[ \t]*\n(.*?)\n?```\s*$", r"\1", value or "", flags=re.S)
    try:
        top = json.loads(raw, object_pairs_hook=_once, parse_constant=_refused)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, (dict, list)):
        return None
    found = dict.fromkeys(SHAPE, 0)
    stack: list[tuple[object, bool]] = [(top, False)]
    while stack:
        now, named = stack.pop()
        if isinstance(now, (dict, list)):
            found["containers"] += 1
            stack += [(v, True) for v in now.values()] if isinstance(now, dict) else [(v, named) for v in now]
        else:
            found["scalars"] += 1
            found["named_leaves"] += named
            found["named_texts"] += named and isinstance(now, str) and bool(now.strip())
    return found


SHAPE = ("containers", "scalars", "named_leaves", "named_texts")


def json_shapes(c: Column) -> Column:
    """The counts of ``json_shape`` in the order of ``SHAPE``; null if it isn't strict JSON."""
    return by_value(lambda v: list(found.values()) if (found := json_shape(v)) else None, "array<long>")(c)


def prompt_tier(c: Column) -> Column:
    """1 for non-empty JSON, 2 for two headings or more, 3 for text, 4 for nothing."""
    parsed = F.try_parse_json(F.when(F.trim(c).rlike(r"^[\[{]"), c))
    full = parsed.isNotNull() & ~F.regexp_replace(c, r"[ \t\n\r]", "").isin("{}", "[]")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", 4).when(F.coalesce(full, F.lit(False)), 1).when(F.regexp_count(c, F.lit(r"(?m)^#{1,6} ")) >= 2, 2).otherwise(3)


def structural_score(c: Column) -> Column:
    """Sections, bullets, key-value lines, slots and words weighed to at most 100."""
    many = lambda p, most, each: F.least(F.regexp_count(c, F.lit(p)), F.lit(most)) * each
    score = many(r"(?m)^#{1,6} ", 5, 6) + many(r"(?m)^[ \t]*[-*] ", 10, 2) + many(r"(?m)^[A-Za-z][A-Za-z ]{0,30}: ", 10, 2) + many(r"\{[^}\n]{1,80}\}", 5, 2) + F.least(F.floor(F.regexp_count(c, F.lit("[^ \t\n\r]+")) / 20), F.lit(20))
    return F.coalesce(score, F.lit(0)).cast("long")


#: What opens a literal argument, and its two fields.  ``[[name|default]]`` is a short form of our own.
OPENS, FIELDS = "{argument", ("name", "default")
_SHORT = re.compile(r"\[\[([A-Za-z_][\w -]*?)(?:\|([^\]\n]*))?\]\]")
MARKS = re.compile(rf"{re.escape(OPENS)}\b|\[\[")


def quoted(value: str, at: int) -> tuple[str, int] | None:
    """The raw content of the quoted string that begins at ``at``, and where it ends; None if none does.

    A string in plain quotes ends at its quote, and a backslash takes the next character with it.  One that stands in text
    which was itself escaped opens and closes with a backslash and a quote, and every other backslash is content.
    """
    escaped = value.startswith('\\"', at)
    mark = '\\"' if escaped else value[at : at + 1]
    if not escaped and mark not in ('"', "'"):
        return None
    place = start = at + len(mark)
    while place < len(value):
        if value.startswith(mark, place):
            return value[start:place], place + len(mark)
        place += 2 if value[place] == "\\" and not escaped else 1
    return None


def argument_at(value: str, at: int) -> dict | None:
    """The argument that opens at ``at``: its fields in their order, the second may be missing, each a quoted string."""
    place, told = at + len(OPENS), {}
    for field in FIELDS:
        gap = re.compile(rf"\s+{field}=").match(value, place)
        got = gap and quoted(value, gap.end())
        if not got:
            break
        told[field], place = got
    close = re.compile(r"\s*\}").match(value, place)
    return {"begin": at, "end": close.end(), "name": told["name"], "default": told.get("default")} if close and "name" in told else None


def arguments(value: str | None) -> list[dict]:
    """Every literal argument of a prompt, in order: begin, end, name, default, as they stand; a mark that opens none has no name.

    The leftmost holds; what opens within it is part of it.
    """
    out, at = [], 0
    for m in MARKS.finditer(value or ""):
        if m.start() < at:
            continue
        if m[0] == OPENS:
            found = argument_at(value, m.start())
        else:
            short = _SHORT.match(value, m.start())
            found = short and {"begin": short.start(), "end": short.end(), "name": short[1], "default": short[2]}
        out.append(found or {"begin": m.start(), "end": m.end(), "name": None, "default": None})
        at = out[-1]["end"]
    return out


def argument_list(c: Column) -> Column:
    return by_value(arguments, "array<struct<begin:int,end:int,name:string,default:string>>")(c)


def fences(value: str | None) -> list[dict]:
    """The fenced blocks of a markdown text as they stand, final line feed and all, with the anchor above them and their language."""
    out, anchor, opened, held = [], None, None, []
    for line in (value or "").splitlines(keepends=True):
        mark = re.match(r"(`{3,}|~{3,})[ \t]*([\w+-]*)[^`\n]*\n?$", line)
        if opened:
            if mark and mark[1].startswith(opened[0]) and not mark[2]:
                out.append({"anchor": anchor, "language": opened[1], "body": "".join(held)})
                opened, held = None, []
            else:
                held.append(line)
        elif mark:
            opened = mark[1], mark[2] or None
        else:
            found = re.search(r'<a[ ]+(?:id|name)="([^"]+)"', line)
            anchor = found[1] if found else anchor
    return out


def fence_list(c: Column) -> Column:
    return by_value(fences, "array<struct<anchor:string,language:string,body:string>>")(c)


def stable_json(value: Column) -> Column:
    """A map of strings as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def point_id(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    return by_value(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_URL, v)), "string")(name)


def kept_similarity(name: str, c: Column) -> Column:
    """(value to six decimals, flag): values outside -1 to 1 are null and flagged."""
    good = c.between(-1.0, 1.0) & ~F.isnan(c)
    return F.struct(F.when(good, F.round(c, 6)).alias("value"), F.when(c.isNotNull() & ~good, F.lit(f"invalid_{name}")).alias("flag"))


def member_group_id(kind: str, members: Column) -> Column:
    """From the kind and the sorted members, NUL between."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\0"), 256), 1, 24))


def flat_strings(value: str | None) -> list[str]:
    """The strings of a JSON text, depth first, keys sorted."""
    out: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, str):
            out.append(x)
        for y in [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else ():
            walk(y)

    try:
        walk(json.loads(value or "null"))
    except ValueError:
        return []
    return out


def strings_of(c: Column) -> Column:
    return by_value(flat_strings, "array<string>")(c)
