"""Text functions on Columns. Unicode forms need Python and go through Arrow; all else stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.batches import row_udf

#: Letters by the moderation rules: ASCII and U+00C0 to U+1EF9.
LETTERS = "a-zA-ZÀ-ỹ"
#: Look-alike digits and signs, and the letters they stand for.
LOOKALIKE_FROM, LOOKALIKE_TO = "4310598@", "aeiosgba"
SEPARATORS = r".\-_·~"
_LOOKALIKE = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
#: From the first to the last letter, digit or underscore of a token.
_CORE = regex.compile(r"[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?", regex.DOTALL)
#: Punctuation cut from the ends of dictionary tokens.
EDGE = r"""[.,!?;:"'()\[\]{}<>*~`_\-]"""


nfc = row_udf(T.StringType(), lambda x: None if x is None else unicodedata.normalize("NFC", x))

#: The block of combining characters but the joiner among them, which isn't one; no character before the block is.
_MARKS, _HIGH = re.compile("[\u0300-\u034e\u0350-\u036f]+"), re.compile("[^\x00-\u036f]+")


def strip_marks(x: str) -> str:
    """Without diacritics; the crossed d becomes d."""
    if x.isascii():
        return x
    x = unicodedata.normalize("NFD", x.replace("đ", "d").replace("Đ", "D"))
    return _HIGH.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), _MARKS.sub("", x))


#: strip_marks of a column.
fold = row_udf(T.StringType(), lambda x: None if x is None else strip_marks(x))
_nfkc_casefold = row_udf(T.StringType(), lambda x: unicodedata.normalize("NFKC", x).casefold().strip() if x is not None else "")


def canonical(text: Column | str) -> Column:
    """Key of equal texts: NFKC, case folding, control and format characters deleted, white space squeezed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(_nfkc_casefold(text), r"[\p{Cf}\p{Cc}]", ""), r"(?U)\s+", " "))


def tokens(text: Column | str) -> Column:
    """Letter runs, taken first and then lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1)), F.lower)


def white_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def lookalike(text: Column) -> Column:
    """In each token that doesn't start with a digit and has more letters than look-alikes, look-alikes become letters."""

    def one(t: Column) -> Column:
        alpha = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        like = F.length(t) - F.length(F.translate(t, LOOKALIKE_FROM, ""))
        return F.when((like == 0) | t.rlike("^[0-9]") | (alpha <= like), t).otherwise(F.translate(t, LOOKALIKE_FROM, LOOKALIKE_TO))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), F.lit(1)), one), "")


def separators(text: Column) -> Column:
    """One separator between two letters goes."""
    return F.regexp_replace(text, f"(?<=[{LETTERS}])[{SEPARATORS}](?=[{LETTERS}])", "")


def elongation(text: Column) -> Column:
    """Letter runs of three or more become one letter."""
    return F.regexp_replace(text, rf"([{LETTERS}])\1{{2,}}", "$1")


def drop_plain(x: str) -> str:
    """A letter goes if the input's letter before it has a mark and the same base."""
    if not x or x.isascii():
        return x
    keep = [True] + [not (p != c and p.isalpha() and c.isalpha() and strip_marks(p) == strip_marks(c) != p) for p, c in zip(x, x[1:])]
    return "".join(c for c, k in zip(x, keep) if k)


#: drop_plain of a column.
plain_after_marked = row_udf(T.StringType(), lambda x: None if x is None else drop_plain(x))


def restore(text: Column, lexicon: Column) -> Column:
    """Tokens whose core is in the map lexicon are replaced; a capital at the start is passed on. White space becomes single spaces.

    Three passes, as an expression that a lambda uses twice is worked out twice: each token's core (one pattern), its entry, and the new token where there is one.
    """
    core = lambda w: F.struct(w.alias("w"), F.regexp_extract(w, r"^[^\p{L}\p{N}_]*+(.*[\p{L}\p{N}_])?", 1).alias("core"))
    entry = lambda x: F.struct(x["w"].alias("w"), x["core"].alias("core"), F.element_at(lexicon, F.lower(x["core"])).alias("new"))

    def one(x: Column) -> Column:
        w, core, new = x["w"], x["core"], x["new"]
        lead = F.regexp_extract(w, r"^([^\p{L}\p{N}_]*)", 1)
        trail = F.substring(w, F.length(lead) + F.length(core) + 1, F.length(w))
        cap = F.substring(core, 1, 1)
        new = F.when((cap == F.upper(cap)) & (cap != F.lower(cap)), F.concat(F.upper(F.substring(new, 1, 1)), F.expr("''"), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
        return F.when(x["new"].isNull() | (core == ""), w).otherwise(F.concat(lead, new, trail))

    parts = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.transform(F.transform(F.transform(parts, core), entry), one), " ")


def lexicon_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(entries.items()) for x in kv]) if entries else F.create_map().cast("map<string,string>")


def normalize(text: Column, entries: dict[str, str]) -> Column:
    """The rule normaliser: NFC, look-alikes, separators, elongation, lexicon, in this order."""
    out = plain_after_marked(elongation(separators(lookalike(nfc(text)))))
    return restore(out, lexicon_map(entries)) if entries else out


def normalize_one(x: str, entries: dict[str, str] | None = None) -> str:
    """normalize of one text in plain Python, for generators that retry inside a batch."""

    def letters(m: re.Match[str]) -> str:
        t = m[0]
        like = sum(c in LOOKALIKE_FROM for c in t)
        if "0" <= t[0] <= "9" or not like or sum(map(str.isalpha, t)) <= like:
            return t
        return t.translate(_LOOKALIKE)

    def known(w: str) -> str:
        core = _CORE.search(w)
        new = entries.get(core[0].lower()) if core else None
        if new is None:
            return w
        cap = core[0][0]
        return w[: core.start()] + (new[:1].upper() + new[1:] if cap == cap.upper() != cap.lower() else new) + w[core.end() :]

    x = re.sub(r"[^ \t\n\x0b\f\r]+", letters, unicodedata.normalize("NFC", x))
    x = re.sub(f"(?<=[{LETTERS}])[{SEPARATORS}](?=[{LETTERS}])", "", x)
    x = drop_plain(re.sub(rf"([{LETTERS}])\1{{2,}}", r"\1", x))
    return " ".join(map(known, regex.findall(r"\P{White_Space}+", x))) if entries else x


def strip_edges(token: Column) -> Column:
    return F.regexp_replace(token, f"^{EDGE}+|{EDGE}+$", "")


def case_like(original: Column, new: Column) -> Column:
    """All capitals, a capital first, or as it is."""
    return F.when((original == F.upper(original)) & (original != F.lower(original)) & (F.length(original) > 1), F.upper(new)).when(F.substring(original, 1, 1) != F.lower(F.substring(original, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.expr("''"), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def softmax_second(first: Column, second: Column) -> Column:
    """The second of two logits' share: the sigmoid of their difference."""
    return sigmoid(second - first)


def label_id(text: Column, names: dict[str, int]) -> Column:
    key = F.lower(F.trim(text))
    out = F.lit(-1)
    for name, i in names.items():
        out = F.when(key == name.lower(), F.lit(i)).otherwise(out)
    return out


def bucket(v: Column, low: float) -> Column:
    return F.when(v >= 0.5, "strong").when(v >= 0.25, "medium").when(v >= low, "weak").otherwise("none")


#: Terminal colours of the levels.
ANSI = {"strong": "\x1b[1;97;41m", "medium": "\x1b[1;30;43m", "weak": "\x1b[4m"}


def highlight(words: Column, values: Column, low: float, kind: str = "markdown") -> Column:
    """Words by the level of their values. markdown: strong ones in bold, medium and weak ones in italics; plain: all of them in brackets; ansi: a colour for each level."""

    def around(w: Column, left: str, right: str) -> Column:
        return F.concat(F.lit(left), w, F.lit(right))

    def mark(w: Column, v: Column) -> Column:
        level = bucket(v, low)
        if kind == "plain":
            return F.when(level == "none", w).otherwise(around(w, "[", "]"))
        signs = {"strong": ("**", "**"), "medium": ("*", "*"), "weak": ("*", "*")} if kind == "markdown" else {k: (v, "\x1b[0m") for k, v in ANSI.items()}
        out = w
        for name, (left, right) in signs.items():
            out = F.when(level == name, around(w, left, right)).otherwise(out)
        return out

    if kind not in ("markdown", "plain", "ansi"):
        raise ValueError(f"kind is {kind}")
    return F.array_join(F.zip_with(words, values, mark), " ")
