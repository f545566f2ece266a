"""Column functions for text, URLs, numbers and times. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = "^(utm_[a-z]+|fbclid|gclid|yclid|_ga|ref|spm)="


def normalized(text: Column, words: int = 120) -> Column:
    """Lower case, tags and signs to spaces, single spaces, at most so many words; null counts as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N} ]", " "), " +", " "))
    return F.array_join(F.slice(F.split(plain, " "), 1, words), " ")


def bigrams(text: Column) -> Column:
    """Distinct two-character strings of a text without spaces; a text of at most one character is its own."""
    pairs = lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - 1), lambda i: F.substr(d, i, F.lit(2)))
    one = lambda d: F.when(F.length(d) <= 1, F.array(d)).otherwise(F.array_distinct(pairs(d)))
    return F.get(F.transform(F.array(F.replace(text, F.lit(" "), F.lit(""))), one), F.lit(0))  # the dense text is made once, not for each pair


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def title_key(title: Column) -> Column:
    """Letters and digits only; too short a title has no key."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "<[^>]*>", ""), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(key) < 10, F.lit("")).otherwise(key)


def canonical_url(url: Column) -> Column:
    """No scheme, www., fragment, closing slash or tracking parameters; the others decoded and in order."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(www\.)?", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    host = F.lower(F.regexp_extract(path, "^([^/]*)", 1))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), lambda p: F.coalesce(F.try_url_decode(p), p)))
    return F.concat(host, F.regexp_replace(path, "^[^/]*", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def absolute_url(href: Column, base: Column) -> Column:
    """An address of a page as a whole: other schemes as they are, //host with the base's scheme, /path at its host, ?query and
    #fragment at its path, anything else beside it; . and .. are resolved."""
    href, base = F.trim(F.coalesce(href, F.lit(""))), F.trim(F.coalesce(base, F.lit("")))
    origin, path = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    place = F.regexp_replace(href, r"(?s)[?#].*$", "")
    whole = F.when(place.startswith("/"), place).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), place))
    parts = F.split(F.regexp_replace(whole, "^/", ""), "/")
    ends = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, resolved, tail))
    )


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text, in lower case, holds any of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the words that a text holds, however often."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(w)), F.lit(n)).otherwise(F.lit(0)) for w, n in weights.items()), F.lit(0))


def amount(text: Column) -> Column:
    """A number as text: a comma is decimal only before one or two closing digits; null if it is no number."""
    tight = F.regexp_replace(text, " ", "")
    decimal = F.regexp_replace(tight, r",(\d{1,2})$", ".$1")
    return F.regexp_replace(decimal, ",", "").try_cast("double")


def html_to_text(page: Column) -> Column:
    """Text of a page for length checks: scripts and styles dropped, tags to spaces, five entities decoded."""
    text = F.regexp_replace(F.coalesce(page, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the array a stands in b, in order but with gaps."""
    matched = F.aggregate(b, F.lit(0), lambda i, x: F.when((i < F.size(a)) & (F.get(a, i) == x), i + 1).otherwise(i))
    return matched == F.size(a)


def outside_protected(text: Column, pattern: str) -> Column:
    """text without what pattern matches, but with its tags and quoted titles as they are."""
    pieces = F.regexp_extract_all(text, F.lit("<[^>]*>|«[^»]*»|[^<«]+|[<«]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("(?s)^(<.*>|«.*»)$"), p).otherwise(F.regexp_replace(p, pattern, ""))), "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common substring. It grows by at most one with each further character of a."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda best, i: F.when(F.contains(b, F.substr(a, i - best, best + 1)), best + 1).otherwise(best))


def fingerprint(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a text."""
    units = F.flatten(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c: F.when(F.ascii(c) > 65535, F.array(55296 + F.shiftright(F.ascii(c) - 65536, 10), 56320 + (F.ascii(c) - 65536) % 1024)).otherwise(F.array(F.ascii(c))),
        )
    )
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: h.bitwiseXOR(u.cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"))
