"""Text functions: hashes, vocabularies, anchors, signatures, category cascade.

All are column expressions of built-in functions, so they run in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


#: Words that turn a verb round (fixed values).
NEGATIONS = ("not", "no", "never", "denies", "without", "fails", "refuses")


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_hash(c: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the stripped, lower-cased title."""
    return F.substring(F.sha2(F.lower(stripped(c)).cast("binary"), 256), 1, 32)


def tokens(c: Column) -> Column:
    """Lower-cased words, with all but letters, digits and underscores taken as blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda t: t != "")


def story_hash(c: Column) -> Column:
    """SHA-1 (16 hex digits) of the sorted words of three letters or more; of the title itself if none is left."""
    low = F.lower(c)
    # What parts words, digits among it, in one pass; texts of ASCII alone, the usual case, need no Unicode classes.
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(low, r"(?U)[\W\d]+", " ")).otherwise(F.regexp_replace(low, "[^a-z_]+", " "))
    words = F.array_sort(F.filter(F.split(plain, " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(*V.STORY_STOPWORDS)))
    return F.substring(F.sha1(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(stripped(F.lower(c))).cast("binary")), 1, 16)


def tickers(c: Column) -> Column:
    """Sorted tickers whose words stand in the text, null if none."""
    by: dict[str, list[str]] = {}
    for word, ticker in V.TICKER_WORDS.items():
        if ticker != "STABLE":
            by.setdefault(ticker, []).append(word)
    low = F.lower(c)
    found = F.array_compact(F.array(*[F.when(low.rlike(r"(?U)\b(" + "|".join(map(re.escape, words)) + r")\b"), F.lit(t)) for t, words in sorted(by.items())]))
    return F.when(F.size(found) > 0, found)


def plain_words(c: Column) -> Column:
    """Lower-cased text in which letters beyond ASCII are underscores and other such characters blanks.

    Word borders then fall where Unicode has them, and patterns can use the
    much faster ASCII classes.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\W&&[^\x00-\x7F]]", " "), r"[^\x00-\x7F]", "_")


def category(c: Column) -> Column:
    """Struct(category, causal) of the first rule with a pattern in the text."""
    low, out = plain_words(c), None
    for name, causal, patterns in V.CATEGORY_RULES:
        hit = low.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))
        value = F.struct(F.lit(name).alias("category"), F.lit(causal).alias("causal"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("uncategorized").alias("category"), F.lit(True).alias("causal")))


def cascade(c: Column) -> Column:
    """Struct(score, words): weights of the vocabulary's entries contained in the text, each once."""
    low = F.lower(c)
    hits = [(F.contains(low, F.lit(w)).cast("int"), weight) for w, weight in V.CASCADE_WEIGHTS.items()]
    score, count = F.lit(0.0), F.lit(0)
    for hit, weight in hits:
        score, count = score + hit * weight, count + hit
    return F.struct(score.alias("score"), count.alias("words"))


def _known() -> dict[str, str]:
    one = {a: a for a in V.ANCHORS if " " not in a}
    return one | {a: to for a, to in V.ALIASES.items() if " " not in a and to in V.ANCHORS}


def anchors(c: Column) -> Column:
    """Sorted named entities of the text, under their common names."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    pairs = [(a, a) for a in V.ANCHORS if " " in a] + [(a, to) for a, to in V.ALIASES.items() if " " in a]
    long = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {phrase} ")), F.lit(name)) for phrase, name in pairs]))
    table = F.create_map(*[F.lit(x) for item in _known().items() for x in item])
    # An alias takes the place of a word even where the word is an anchor itself.
    alias = F.create_map(*[F.lit(x) for item in ((a, t) for a, t in V.ALIASES.items() if " " not in a) for x in item])
    single = F.filter(F.transform(tokens(c), lambda t: F.element_at(table, F.coalesce(F.element_at(alias, t), t))), lambda t: t.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(long, single)))


def keywords(c: Column) -> Column:
    """Sorted distinct words that matter: anchors under their names, and other words of three characters or more."""
    low = tokens(c)
    padded = F.concat(F.lit(" "), F.array_join(low, " "), F.lit(" "))
    multi = [(a, a.replace(" ", "_")) for a in V.ANCHORS if " " in a] + [(a, to) for a, to in V.ALIASES.items() if " " in a]
    long = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {phrase} ")), F.lit(name)) for phrase, name in multi]))
    alias = F.create_map(*[F.lit(x) for item in ((a, t) for a, t in V.ALIASES.items() if " " not in a) for x in item])
    names = F.array(*map(F.lit, V.ANCHORS))
    stop = F.array(*map(F.lit, V.STOPWORDS))

    def keep(t):
        name = F.coalesce(F.element_at(alias, t), t)
        plain = (F.char_length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike(r"(?U)^\d+$")
        return F.when(F.array_contains(names, name), name).when(plain, t)

    return F.array_sort(F.array_distinct(F.concat(long, F.filter(F.transform(low, keep), lambda t: t.isNotNull()))))


def actor_pairs(anchor: Column) -> Column:
    """Sorted 'a+b' pairs of nations with nations, actions and places, and of institutions with actions and crypto names."""
    kind = {k: F.array_intersect(anchor, F.array(*map(F.lit, v))) for k, v in (("n", V.NATIONS), ("i", V.INSTITUTIONS), ("c", V.CRYPTOS), ("a", V.ACTIONS), ("l", V.LOCATIONS))}

    def cross(a, b, change=lambda x: x):
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_join(F.array_sort(F.array(x, change(y))), "+"))))

    same = F.flatten(F.transform(kind["n"], lambda x: F.transform(F.filter(kind["n"], lambda y: y > x), lambda y: F.concat(x, F.lit("+"), y))))
    underscored = lambda y: F.replace(y, F.lit(" "), F.lit("_"))
    parts = [same, cross(kind["n"], kind["a"]), cross(kind["i"], kind["a"], underscored), cross(kind["i"], kind["c"]), cross(kind["n"], kind["l"])]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def suffix(direction: Column) -> Column:
    """Part of a signature that a strong direction adds."""
    return F.when(direction.isin("escalation", "de-escalation"), F.concat(F.lit("-"), direction)).otherwise("")


def signature(anchor: Column, keyword: Column, direction: Column) -> Column:
    """Up to four sorted anchors, else the three longest keywords (ties in alphabetical order), and the suffix."""
    named = F.slice(F.array_sort(F.transform(anchor, lambda a: F.replace(a, F.lit(" "), F.lit("_")))), 1, 4)
    ordered = F.transform(F.slice(F.array_sort(F.transform(keyword, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))), 1, 3), lambda s: s["k"])
    return F.concat(F.array_join(F.when(F.size(anchor) > 0, named).otherwise(ordered), "-"), suffix(direction))


def signature_root(sig: Column) -> Column:
    """A signature without its direction."""
    return F.regexp_replace(sig, "-(de-)?escalation$", "")


def verb_category(lemma: Column) -> Column:
    pairs = [(w, name) for name, (_, _, lemmas, nouns) in V.VERBS.items() for w in f"{lemmas} {nouns}".split()]
    table = dict(reversed(pairs))  # the first category that lists a lemma keeps it
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.lower(lemma)), F.lit("unknown"))


def direction(category_: Column, negated: Column) -> Column:
    """Direction of a verb category, turned round by negation."""
    table = F.create_map(*[F.lit(x) for name, v in V.VERBS.items() for x in (name, v[0])])
    base = F.element_at(table, category_)
    turned = F.when(base == "escalation", "de-escalation").when(base == "de-escalation", "escalation").otherwise(base)
    return F.coalesce(F.when(negated, turned).otherwise(base), F.lit("unknown"))


def first_verb(c: Column) -> Column:
    """Struct(lemma, negated): the first word of the text that the verb taxonomy lists, and whether a negation stands within three words before it.

    A stand-in for a dependency parse: inflected forms count where stripping
    -s, -ed, -d or -ing (with a final e put back) leaves a listed verb.
    """
    listed = sorted({w for _, _, lemmas, nouns in V.VERBS.values() for w in f"{lemmas} {nouns}".split()})
    forms = {f: w for w in reversed(listed) for f in (w, f"{w}s", f"{w}ed", f"{w}d", f"{w}ing", f"{w[:-1]}ing" if w.endswith("e") else w)}
    table = F.create_map(*(F.lit(x) for item in sorted(forms.items()) for x in item))
    words = tokens(c)
    hits = F.filter(F.transform(words, lambda t, i: F.struct(F.element_at(table, t).alias("lemma"), i.alias("i"))), lambda h: h["lemma"].isNotNull())
    first = F.get(hits, F.lit(0))
    before = F.slice(words, F.greatest(first["i"] - 2, F.lit(1)), F.least(first["i"], F.lit(3)))
    negated = F.when(first.isNull(), False).otherwise(F.exists(before, lambda t: t.isin(*NEGATIONS)))
    return F.struct(first["lemma"].alias("lemma"), negated.alias("negated"))


def json_merge(a: Column, b: Column, values: str = "int") -> Column:
    """Two flat JSON objects as one; where both have a key, the second's value stays."""
    kind = f"map<string,{values}>"
    return F.to_json(F.map_zip_with(F.from_json(a, kind), F.from_json(b, kind), lambda k, x, y: F.coalesce(y, x)))


def slug_title(url: Column, names: Column | None = None) -> Column:
    """Readable title of a URL's last part, else the first six longer names of a 'name,offset;...' list, else ''."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(html?|php|aspx?)$", "")
    slug = stripped(F.regexp_replace(last, "[-_]", " "))
    good = (F.char_length(slug) >= 15) & (F.size(F.regexp_extract_all(slug, F.lit("([a-zA-Z]+)"), 1)) >= 3)
    other = F.lit("")
    if names is not None:
        own = F.slice(F.filter(F.transform(F.filter(F.split(names, ";"), lambda p: p != ""), lambda p: F.element_at(F.split(p, ","), 1)), lambda n: F.char_length(n) > 2), 1, 6)
        other = F.coalesce(F.when(F.size(own) >= 2, F.substring(F.array_join(own, " "), 1, 300)), F.lit(""))
    return F.when(good, F.substring(slug, 1, 300)).otherwise(other)


def domain_tier(domain: Column) -> Column:
    """Tier of a source domain, a leading 'www.' taken off."""
    bare = F.regexp_replace(F.lower(domain), r"^www\.", "")
    return F.when(bare.isin(*V.TIER1_DOMAINS), "tier1").when(bare.isin(*V.TIER2_DOMAINS), "tier2").otherwise("tier3")


def state_of_age(hours: Column) -> Column:
    """ACTIVE, FADING, STALE or ARCHIVED by hours since the first sight."""
    return F.when(hours < V.ACTIVE_HOURS, "ACTIVE").when(hours < V.FADING_DAYS * 24, "FADING").when(hours < V.STALE_DAYS * 24, "STALE").otherwise("ARCHIVED")


#: Corners (hours, impact) between which impact falls in straight lines; beyond the last it is 0 (fixed values).
IMPACT_CORNERS = ((2, 1.0), (24, 0.7), (72, 0.3), (168, 0.1))


def impact_of_age(hours: Column) -> Column:
    """Impact 1 for two hours, then falling in straight lines to 0.1 at seven days, then 0."""
    out = F.when(hours <= IMPACT_CORNERS[0][0], 1.0)
    for (a, x), (b, y) in zip(IMPACT_CORNERS, IMPACT_CORNERS[1:], strict=False):
        out = out.when(hours <= b, x - (hours - a) / (b - a) * (x - y))
    return out.otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
