"""Text functions over columns. All but nfkc() stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin spellings of the Russian letters; the empty ones are dropped.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
DASHES = "[‐‑‒–—−-]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is read, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def folded(text: Column) -> Column:
    """Lower case, ё as е, dashes and marks as single spaces; of text that is already in normal form."""
    text = F.regexp_replace(F.lower(text), "ё", "е")
    text = F.regexp_replace(text, DASHES, " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")
    return F.trim(text)


def normalize_text(text: Column) -> Column:
    """What two spellings of one name have in common. Only text beyond ASCII visits Python."""
    return folded(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(nfkc(text)))


def transliterate(text: Column, letters: dict[str, str] = LATIN) -> Column:
    """Latin spelling: one-letter ones at once, the longer ones one by one."""
    single = {k: v for k, v in letters.items() if len(v) == 1}
    dropped = "".join(k for k, v in letters.items() if not v)
    out = F.translate(text, "".join(single) + dropped, "".join(single.values()))
    for k, v in letters.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def slug(text: Column, letters: dict[str, str] = LATIN) -> Column:
    return F.regexp_replace(transliterate(folded(text), letters), r"\s+", "-")


def slug_variants(text: Column) -> Column:
    """Spellings that sites use in addresses: with h or kh, ts or c, dashes or underscores."""
    one = slug(text)
    other = slug(text, LATIN | {"х": "kh", "ц": "c"})
    return F.array_distinct(F.array(one, other, F.replace(one, F.lit("-"), F.lit("_")), F.replace(one, F.lit("-"), F.lit(""))))


def title_of_slug(text: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(text), r"[?#].*$", ""), r"[-_+]+", " ")
    return F.initcap(F.trim(F.regexp_replace(words, r"\s+", " ")))


def has_words(title: Column, alias: Column) -> Column:
    """Whether normalised `alias` stands in normalised `title` as whole words."""
    return F.contains(F.concat(F.lit(" "), title, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" "))) & (F.length(alias) > 0)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form for a count."""
    last, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def without_tags(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags part words, common entities are decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: What error messages must not carry, and what stands for it.
HIDDEN = (
    (r"https?://[^ \n\t]+", "[url]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]"),
    (r"(token|secret|password|key)( *[:=] *)[^ \n\t,;]+", "$1$2[hidden]"),
    (r"Bearer +[A-Za-z0-9._-]+", "Bearer [hidden]"),
    (r"[A-Fa-f0-9]{32,}", "[hidden]"),
)


def redacted(text: Column, limit: int = 500) -> Column:
    for pattern, instead in HIDDEN:
        text = F.regexp_replace(text, pattern, instead)
    return F.substring(text, 1, limit)


def tab_name(text: Column, limit: int = 100) -> Column:
    """A sheet tab's name: no reserved marks, single spaces, bounded."""
    plain = F.regexp_replace(text, r"[\[\]*?/\\:]+", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "^'+|'+$", ""), r"\s+", " "))
    return F.rtrim(F.substring(plain, 1, limit))


def tab_identity(name: Column) -> Column:
    """Two tabs with one identity collide."""
    return F.lower(F.trim(name))


#: Localised names of sheet functions.
FORMULA_NAMES = {"СУММ": "SUM", "СЧЁТЕСЛИМН": "COUNTIFS", "СЧЁТЕСЛИ": "COUNTIF", "ЕСЛИОШИБКА": "IFERROR", "ЕСЛИ": "IF"}


def formula(text: Column) -> Column:
    """A formula without what spelling changes: spaces, case, separators, localised names."""
    out = F.regexp_replace(F.upper(text), r"\s+", "")
    for local, plain in FORMULA_NAMES.items():
        out = F.replace(out, F.lit(local + "("), F.lit(plain + "("))
    return F.replace(out, F.lit(";"), F.lit(","))


def safe_cell(text: Column) -> Column:
    """Clipboard cell: no formula may start it, quotes are doubled where quoting is needed."""
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('["\t\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def cleaned(text: Column, limit: int = 500) -> Column:
    """Evidence text: compatibility forms folded but for the number sign, single spaces, bounded."""
    kept = F.replace(nfkc(F.replace(text, F.lit("№"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("№"))
    return F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, limit)


def without_words(text: Column, words: list[str]) -> Column:
    """The text without the given names, longest first, where they stand as whole words."""
    import re

    for word in sorted(words, key=lambda w: (-len(w), w)):
        body = r"[\s‐‑‒–—−-]*".join(re.escape(p) for p in re.split(r"[\s‐‑‒–—−-]+", word) if p)
        text = F.regexp_replace(text, r"(?iu)(^|[^\p{L}\p{N}])" + body + r"(?=$|[^\p{L}\p{N}])", "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fuller_title(first: Column, second: Column) -> Column:
    """Of two titles the one that states a pack, else the one that is not cut short, else the longer."""
    pack = lambda t: t.rlike(r"(?iu)(№|\d+\s*(шт|таб|капс))")
    cut = lambda t: t.rlike(r"(…|\.\.\.)\s*$")
    longer = F.when(F.length(first) >= F.length(second), first).otherwise(second)
    told = F.when(pack(first) & ~pack(second), first).when(pack(second) & ~pack(first), second)
    whole = F.when(cut(second) & ~cut(first), first).when(cut(first) & ~cut(second), second)
    return F.coalesce(told, whole, longer, first, second)
