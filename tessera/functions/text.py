"""Scalar functions over text: canonical form, hashes, ids, words, sentences, roles, chunks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed class of function words, and contractions that a tokenizer splits off.
FUNCTION_WORDS = (
    "a an the this that these those my your his her its our their i you he she it we they me him us them who whom whose which what "
    "of in on at to for with by from about as into onto over under between through during before after above below up down out off "
    "near since until upon within without and or but nor so yet if then than because while when where though although whether "
    "is are was were be been being am has have had do does did will would can could may might shall should must "
    "not no there here also just very too only more most such each every some any all both either neither other another own same"
).split()
CLITICS = ["'s", "'t", "'re", "'ll", "'d", "'ve", "'m", "’s", "’t", "’re", "’ll", "’d", "’ve", "’m"]
# Patterns of handles and names.
HANDLE = "^[a-z0-9][a-z0-9._-]{1,63}$"


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical(text: Column, compose: bool = True) -> Column:
    """Composed, with line feeds alone, no blanks at line ends, and trimmed."""
    text = composed(text) if compose else text
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_id(prefix: str, text: Column) -> Column:
    """An id of its content: a prefix and 24 hexadecimal digits."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256(text), 1, 24))


def is_content_id(identifier: Column, prefix: str) -> Column:
    return identifier.rlike(f"^{re.escape(prefix)}-[0-9a-f]{{24}}$")


def is_handle(handle: Column) -> Column:
    return handle.rlike(HANDLE)


def partition_url(scheme: str, slug: Column, document: Column, index: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), slug, F.lit("/"), document, F.lit("/p/"), index.cast("string"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def occurrences(needle: Column, text: Column) -> Column:
    """How often a non-empty string occurs, without overlap."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0))


def sentences(text: Column) -> Column:
    """Cut at a space after an end mark or a quote, before a capital or a quote."""
    return F.split(text, r'(?<=[.?!"]) (?=[\p{Lu}"])')


def sentence_ended(text: Column, following: Column) -> Column:
    """Whether a following piece opens a new sentence after a text."""
    ends = text.rlike(r"[.?!]\s*$") & following.rlike(r"^[\s\p{Lu}]")
    return F.contains(following, F.lit("\n")) | ends


def role(word: Column) -> Column:
    """`form` for punctuation and function words, else `content`."""
    low = F.lower(word)
    closed = word.rlike(r"^\p{L}+$") & low.isin(FUNCTION_WORDS)
    return F.when(~word.rlike(r"[\p{L}\p{N}]") | low.isin(CLITICS) | closed, F.lit("form")).otherwise(F.lit("content"))


def starts_word(text: Column, previous: Column) -> Column:
    """Whether a token opens a word: by what it starts with, or by what the one before ended with."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(False)).otherwise(~text.rlike(r"^[\p{L}\p{N}]") | ~F.coalesce(previous, F.lit("")).rlike(r"[\p{L}\p{N}]$"))


def normalised(stem: Column) -> Column:
    """Lower case, white space collapsed, end marks gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(stem), r"^\s+|\s+$", ""), r"[.?!:,;]+$", ""), r"\s+", " ")


def fill(template: Column, subject: Column) -> Column:
    """`{s}` is the subject, `{S}` the subject with a capital."""
    capital = F.concat(F.upper(F.substring(subject, 1, 1)), F.substr(subject, F.lit(2)))
    return F.replace(F.replace(template, F.lit("{s}"), subject), F.lit("{S}"), capital)


def reads_as_english(text: Column, least: int = 1000, share: float = 0.06) -> Column:
    """Long enough, with enough of the commonest function words."""
    found = words(text)
    common = F.size(F.filter(found, lambda w: w.isin("the", "and", "of")))
    return (F.size(found) >= least) & (common / F.greatest(F.size(found), F.lit(1)) >= share)


def marked(text: Column, number: Column) -> Column:
    """A source's number in double brackets before the white space that ends a text."""
    body = F.regexp_replace(text, r"\s+$", "")
    return F.concat(body, F.lit("[["), number.cast("string"), F.lit("]]"), F.substr(text, F.length(body) + 1))


def ngram_key(*tokens: Column, bits: int) -> Column:
    """Token ids packed into one number, `bits` each."""
    key = F.lit(0).cast("long")
    for t in tokens:
        key = F.shiftleft(key, bits).bitwiseOR(t.cast("long").bitwiseAND(F.lit((1 << bits) - 1)))
    return key


def token_id(token: Column) -> Column:
    """A 16-bit id of a word, from its digest."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 4), 16, 10).cast("long")


def cut_long(sentence: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut at the last space that fits."""
    out = []
    while len(sentence) > most:
        at = sentence.rfind(" ", 0, most)
        at = most if at < 0 else at
        if head := sentence[:at].strip(" \t"):
            out.append(head)
        sentence = sentence[at:].lstrip(" ")
    return [*out, tail] if (tail := sentence.strip(" \t")) else out


def packed_sentences(paragraph: str, most: int) -> list[str]:
    """Whole sentences joined as long as they fit."""
    out: list[str] = []
    for sentence in re.split(r"(?<=[.?!])(?=[ \n])", paragraph):
        for piece in cut_long(sentence.strip(" \t"), most):
            if out and len(out[-1]) + 1 + len(piece) <= most:
                out[-1] += " " + piece
            else:
                out.append(piece)
    return out


def chunks(text: str, most: int = 600, least: int = 120) -> list[str]:
    """Paragraphs between blank lines; long ones are cut by sentences, slivers join what follows, a last one what precedes."""
    pieces: list[str] = []
    for paragraph in re.split(r"\n(?:[^\S\n]*\n)+", text.replace("\r\n", "\n")):
        body = paragraph.strip()
        if body:
            pieces += [body] if len(body) <= most else packed_sentences(body, most)
    out, carry = [], ""
    for piece in pieces:
        carry = f"{carry} {piece}" if carry else piece
        if len(carry) >= least:
            out.append(carry)
            carry = ""
    if carry:
        out = [*out[:-1], f"{out[-1]} {carry}"] if out else [carry]
    return out


def chunked(most: int = 600, least: int = 120):
    """`chunks` as a vectorised function over a column."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t or "", most, least))

    return run
