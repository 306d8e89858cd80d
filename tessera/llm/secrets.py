"""Secret scans: an Aho-Corasick keyword prefilter, expressions anchored at its hits, embedded checksums.

One automaton per batch finds every place where a kind's keyword occurs; the kind's expression is tried only there, in
order and without overlap within the kind, which is what a search over the whole text would find, since each of its
matches starts with a keyword. Long hexadecimal runs have no keyword; their prefilter is the run itself, by bytes.
Kinds whose tokens carry a checksum count only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, map_batches

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(token: str) -> bool:
    """The last six characters are the CRC-32 of those after the prefix up to there, in base 62."""
    body, tail = token[token.index("_") + 1 : -6], token[-6:]
    value = zlib.crc32(body.encode())
    for c in reversed(tail):
        value, digit = divmod(value, 62)
        if BASE62[digit] != c:
            return False
    return value == 0


def mod_97(account: str) -> bool:
    """The check digits of an international bank account number."""
    plain = account.replace(" ", "")
    return len(plain) == ACCOUNT_LENGTHS.get(plain[:2]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def base64_json(token: str) -> bool:
    """The first part of a signed web token is a JSON object in base64; one nested beyond the parser's depth is none."""
    import base64
    import json

    head = token.split(".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, RecursionError):
        return False


#: Countries of account numbers that are looked for, and the length of a number there.
ACCOUNT_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "NL": 18, "IT": 27}


def account_expression() -> str:
    """An account number of its country's length, written as one word or in groups of four."""
    forms = []
    for country, length in ACCOUNT_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        spaced = rf"(?:\x20[0-9A-Z]{{4}}){{{groups}}}" + (rf"\x20[0-9A-Z]{{{rest}}}" if rest else "")
        forms.append(rf"{country}[0-9]{{2}}(?:[0-9A-Z]{{{length - 4}}}|{spaced})")
    return f"(?:{'|'.join(forms)})(?![0-9A-Za-z])"


@dataclass(frozen=True)
class Kind:
    """A kind of secret. Its expression is tried where a keyword occurs, in either case if `fold`; the keyword starts every match.

    Where a match is a run of characters followed by something else, `run` is that run: no other place of a run that failed
    is tried, since all of them end alike, so that the work stays in proportion to the text.
    """

    name: str
    keywords: tuple[str, ...]
    expression: str
    fold: bool = False
    valid: Callable[[re.Match], bool] | None = None
    run: str | None = None


#: The base kinds, in their order in results.
ASSIGN = Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 6)
ACCESS = Kind("access", ("AKIA",), r"AKIA[A-Z0-9]+", False, lambda m: len(m[0]) >= 20)
HEX = "hex"
HEX_LENGTH = 24
#: What the method adds: token formats with a checksum, or of a shape that nothing else has.
ADDED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", False, lambda m: base62_crc32(m[0])),
    Kind("npm", ("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", False, lambda m: base62_crc32(m[0])),
    Kind("jwt", ("eyJ",), r"eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+", False, lambda m: base64_json(m[0]), r"[0-9A-Za-z_-]+"),
    Kind("iban", tuple(ACCOUNT_LENGTHS), account_expression(), False, lambda m: mod_97(m[0])),
    Kind("private_key", ("-----BEGIN ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
)
ORDER = [ASSIGN.name, ACCESS.name, HEX, *[k.name for k in ADDED]]


def hex_runs(text: str, least: int) -> list[tuple[int, int]]:
    """Maximal runs of `[0-9a-f]` of at least `least` characters, in code points."""
    data = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    if len(data) < least:
        return []
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    edges = np.diff(inside)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = last - first >= least
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


class Scanner:
    """Finds spans (start, end, kind) in texts. Built where it is used: an automaton doesn't travel."""

    def __init__(self, kinds: tuple[Kind, ...] = (ASSIGN, ACCESS, *ADDED), least_hex: int = HEX_LENGTH):
        import ahocorasick

        self.kinds, self.least_hex = kinds, least_hex
        self.expressions = [re.compile(k.expression, re.ASCII | (re.IGNORECASE if k.fold else 0)) for k in kinds]
        self.runs = [k.run and re.compile(k.run, re.ASCII) for k in kinds]
        self.exact, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        for fold, automaton in ((False, self.exact), (True, self.folded)):
            words: dict[str, list[tuple[int, int]]] = {}
            for i, kind in enumerate(kinds):
                if kind.fold == fold:
                    for word in kind.keywords:
                        words.setdefault(word, []).append((i, len(word)))
            for word, owners in words.items():
                automaton.add_word(word, owners)
            automaton.make_automaton()
        self.rank = {name: k for k, name in enumerate(ORDER)}

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        if not text:
            return []
        hits: dict[int, set[int]] = {}
        low = text.translate(LOWER) if not text.isascii() else text.lower()
        for automaton, where in ((self.exact, text), (self.folded, low)):
            if len(automaton):
                for end, owners in automaton.iter(where):
                    for i, size in owners:
                        hits.setdefault(i, set()).add(end + 1 - size)
        found = []
        for i, starts in hits.items():
            kind, match, run, after = self.kinds[i], self.expressions[i].match, self.runs[i], 0
            for start in sorted(starts):
                if start < after:
                    continue
                if m := match(text, start):
                    after = m.end()
                    if kind.valid is None or kind.valid(m):
                        found.append((start, after, kind.name))
                elif run:
                    after = run.match(text, start).end()
        found += [(a, b, HEX) for a, b in hex_runs(text, self.least_hex)]
        return sorted(found, key=lambda x: (x[0], self.rank.get(x[2], len(self.rank)), x[1]))


#: Lower-cases A-Z alone, so that places in the text stay the same.
LOWER = {c: c + 32 for c in range(65, 91)}


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, spans (start, end exclusive, kind) in code points, by start, then kind.

    Null and empty texts have no spans. Ids may be null or repeat; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)])

    def run(batches):
        scan = Scanner()
        for part in in_chunks(batches, "text"):
            spans = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in scan(text)] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every secret of a text replaced by its kind in brackets; overlapping spans are one.

    All rows, repeated ones too, and all columns stay, whatever their names. Null and empty texts stay as they are; an empty
    table gives no rows.
    """

    def run(batches):
        scan = Scanner()
        for part in in_chunks(batches, text_col):
            texts = part.column(text_col).to_pylist()
            out = []
            for text in texts:
                spans, pieces, at, k = scan(text), [], 0, 0
                while k < len(spans):
                    start, end, kind = spans[k]
                    while k + 1 < len(spans) and spans[k + 1][0] < end:
                        k += 1
                        end = max(end, spans[k][1])
                    pieces += [text[at:start], f"[{kind}]"]
                    at, k = end, k + 1
                out.append("".join([*pieces, text[at:]]) if spans else text)
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return map_batches(docs, run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of `secrets`, made beside the scan so that the spans need not leave it twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """The base kinds in DuckDB SQL, and all spans where no added kind occurs, as in the test tables.

    Matches and the pieces between them give each match's place.
    """
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = f"""({words})[\\"\'\']?\\x20*[:=]\\x20*[\\"\'\']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, f"regexp_extract_all(x, '{assign}', 2)", 6), ("access", "AKIA[A-Z0-9]+", "regexp_extract_all(x, 'AKIA[A-Z0-9]+')", 20), ("hex", "[0-9a-f]{24,}", "regexp_extract_all(x, '[0-9a-f]{24,}')", 24)]
    parts = [
        f"SELECT doc_id, '{name}' AS kind, {k} AS place, regexp_extract_all(x, '{e}') AS m, string_split_regex(x, '{e}') AS g, {part} AS v, {least} AS least FROM t"
        for k, (name, e, part, least) in enumerate(kinds)
    ]
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), k AS ({" UNION ALL ".join(parts)}),
        u AS (SELECT doc_id, kind, place, least, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM k),
        w AS (SELECT doc_id, kind, place, (list_sum(list_transform(g[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0))::BIGINT AS start, length(m[i]) AS n FROM u WHERE length(v[i]) >= least),
        s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, place) AS spans FROM w GROUP BY 1)
        SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s ON s.doc_id = t.doc_id"""
