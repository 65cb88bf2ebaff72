"""Text scalars as Column functions: markup removal, tokens, emoticons, numbers, spans and rendering.

A null text gives no tokens (an empty array); every function is row-local, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical rules, in the order in which they are tried. RE2 and Java read them alike.
ELLIPSIS = r"\.\.+"
LINK = r"https?://"
EMOTICON = (
    r"<[\\/]?3+|[)(\]\[]-[:;8=]|[(\[][:;8=]|:'-?\(|[:;]o\)|:-\|{1,2}|:\^\)|>?:-?<|>?[:;]-[(\[{O]|>?[:;=][(\[{O]"
    r"|[:;=]-?[>)}PD/o\]\\]|[8:]-?D|:@|:\||D:<?|D[8=]|8\)|\^[-_]\^"
)
NUMBER = r"-?[0-9]+\.[0-9]*|-?[0-9]+"
WORD = r"[a-zA-Z_]+"
PUNCTUATION = r"[;:,.?!]"
TOKEN = "|".join((ELLIPSIS, LINK, EMOTICON, NUMBER, WORD, PUNCTUATION))
# What is dropped from entity-decoded text (short tags, tags with attributes, comments, office
# tags, poll tags, leftover entities).
MARKUP = (
    r"<[^&<=>]{1,15}>|<[^&<=>]*=[^&<>]*>|<![^&<>]*>|</?[wo]:[^&<>]*>|</?st[0-9]:[^&<>]*>|<option +selected>"
    r"|&(?:nbsp|quot|amp);|&#xD;|\r"
)
BASE64 = r"<base64>[^<>]+</base64>"
#: A post-mode sentence ends with one of these, a stream-mode sentence also with an ellipsis.
TERMINATORS = (".", "!", "?")

Text = str | Column


def _column(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_markup(text: Text) -> Column:
    """Text without base64 payloads, tags, comments and leftover entities; entities are decoded beforehand."""
    return F.regexp_replace(F.regexp_replace(_column(text), BASE64, ""), MARKUP, "")


def raw_tokens(text: Text) -> Column:
    """All tokens as written, numbers included."""
    return F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def is_number(token: Column) -> Column:
    return token.rlike(r"^-?[0-9]")


def is_emoticon(word: Text) -> Column:
    """Whether a whole dictionary word is an emoticon (in either case, as words are lower-cased)."""
    return _column(word).rlike(rf"(?i)^(?:{EMOTICON}|XD)$")


def is_punctuation(token: Column) -> Column:
    return token.rlike(rf"^(?:{PUNCTUATION}|{ELLIPSIS})$")


def canonical(token: Column) -> Column:
    """Dots become one ellipsis, hearts one heart, words lower case."""
    return (
        F.when(token.rlike(r"^\.\.+$"), "...")
        .when(token.rlike(r"^<3+$"), "<3")
        .when(token.rlike(r"^<[\\/]3+$"), "</3")
        .otherwise(F.lower(token))
    )


def words(text: Text) -> Column:
    """The tokens that count as words: canonical, without numbers."""
    return F.transform(F.filter(raw_tokens(text), lambda x: ~is_number(x)), canonical)


def tagged_tokens(text: Text) -> Column:
    """array<struct<kind, tok, num>>: kind is word, emoticon, punct or num; num only for numbers."""
    return F.transform(
        raw_tokens(text),
        lambda x: F.struct(
            F.when(is_number(x), "num").when(is_emoticon(x), "emoticon").when(is_punctuation(x), "punct").otherwise("word").alias("kind"),
            F.when(is_number(x), x).otherwise(canonical(x)).alias("tok"),
            F.when(is_number(x), F.regexp_replace(x, r"\.$", "").try_cast("double")).alias("num"),
        ),
    )


def count_words(text: Text) -> Column:
    """Pieces of the text between white space; 0 for empty and null texts."""
    bare = F.trim(F.regexp_replace(F.coalesce(_column(text), F.lit("")), r"[ \t\n\r]+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))).cast("long")


def iso_seconds(text: Text) -> Column:
    """Epoch seconds of an ISO 8601 time with zone; null where it isn't one."""
    return F.unix_seconds(F.try_to_timestamp(_column(text)))


def decode_number(code: Text) -> Column:
    """A number from its 32-bit token code: codes under -2^30 are shifted up by 2^31."""
    value = _column(code).cast("long")
    return F.when(value < -1073741824, value + 2147483648).otherwise(value)


def tag_spans(text: Text, tag: str) -> Column:
    """Contents of <tag>…</tag> in order; null if opening and closing tags differ in number."""
    whole = F.coalesce(_column(text), F.lit(""))
    count = lambda mark: F.size(F.regexp_extract_all(whole, F.lit(mark), F.lit(0)))
    found = F.regexp_extract_all(whole, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(count(f"<{tag}>") == count(f"</{tag}>"), found)


def inject_ids(tokens: Text, user: Text) -> Column:
    """The tokens with the user's mark before, after and, from two words on, in the middle."""
    w, u, n = _column(tokens), F.array(_column(user)), F.size(_column(tokens))
    half = F.floor(n / 2).cast("int")
    middle = F.when(n >= 2, u).otherwise(F.slice(u, 1, 0))
    return F.concat(u, F.slice(w, F.lit(1), half), middle, F.slice(w, half + 1, n), u)


def user_url(user: Text, host: str = "example.org") -> Column:
    return F.concat(F.lit("http://"), _column(user), F.lit(f".{host}/"))


def result_line(score: Text, sentence: Text, url: Text) -> Column:
    return F.format_string("%.3f -- %-100s -- %s", _column(score), _column(sentence), _column(url))
