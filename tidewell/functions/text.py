"""Text functions over columns: tokens, dictionaries, redaction, chunks, parsing."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column, stop: Sequence[str] = (), least: int = 2) -> Column:
    """Distinct words in order of appearance, in lower case, without digits, stop words and short ones."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stop)) if stop else F.length(w) >= least))


def strip_suffix(c: Column, suffixes: Sequence[str], least: int = 2) -> Column:
    """Without the first of the suffixes, longest first, that leaves ``least`` characters."""
    out = F
    for s in sorted(suffixes, key=len, reverse=True):
        out = out.when(c.endswith(s) & (F.length(c) >= len(s) + least), F.substring(c, F.lit(1), F.length(c) - len(s)))
    return out.otherwise(c)


def replace_all(c: Column, table: Mapping[str, str]) -> Column:
    """Literal replacements, the longest key first."""
    for key in sorted(table, key=len, reverse=True):
        c = F.replace(c, F.lit(key), F.lit(table[key]))
    return c


def first_label(c: Column, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None) -> Column:
    """The label of the first group with a term in c."""
    out = F
    for label, terms in groups:
        fits = F.lit(False)
        for t in terms:
            fits = fits | F.contains(c, F.lit(t))
        out = out.when(fits, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def labels(c: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """All labels with a term in c, in the order given."""
    marks = []
    for label, terms in groups:
        fits = F.lit(False)
        for t in terms:
            fits = fits | F.contains(c, F.lit(t))
        marks.append(F.when(fits, F.lit(label)))
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(F.lit(1.0))


# The letters of the Unicode syllables from U+AC00 on, in the order of their numbers.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST_SYLLABLE, SYLLABLES = 0xAC00, len(INITIALS) * len(VOWELS) * (len(FINALS) + 1)


def letters(c: Column) -> Column:
    """Syllables taken apart into their two or three letters, by arithmetic on their numbers; other characters stay."""
    one = lambda table, i: F.substring(F.lit(table), i.cast("int") + 1, F.lit(1))
    rest = len(FINALS) + 1

    def apart(ch: Column) -> Column:
        n = F.ascii(ch) - FIRST_SYLLABLE
        final = n % rest
        parts = F.concat(one(INITIALS, F.floor(n / (len(VOWELS) * rest))), one(VOWELS, F.floor(n / rest) % len(VOWELS)), F.when(final > 0, one(FINALS, final - 1)).otherwise(""))
        return F.when((n >= 0) & (n < SYLLABLES), parts).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), apart), "")


def syllable(n: Column) -> Column:
    """The syllable of a number from 0, by its code: no table is read for it."""
    return F.decode(F.unhex(F.hex((n + FIRST_SYLLABLE).cast("long"))), "UTF-16BE")


def sound_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of letters over the longer length; white space and case do not count, and two empty texts are alike."""
    plain = lambda c: letters(F.lower(F.regexp_replace(c, r"\s+", "")))
    # The transform binds the letters, which lengths and distance read.
    return F.transform(F.array(F.struct(plain(a).alias("a"), plain(b).alias("b"))), lambda p: similarity(p["a"], p["b"]))[0]


def without_fillers(c: Column, fillers: Sequence[str]) -> Column:
    """Words, with one blank between them, less the fillers and the words that repeat the one before; marks at a word's end and case do not count."""
    words = F.transform(F.split(c, "[ \n]+"), lambda w: F.struct(w.alias("w"), F.lower(F.regexp_replace(w, "[.,;:!?]+$", "")).alias("k")))
    # The outer transform binds the words that are left once for all of their numbers.
    kept = F.transform(F.array(F.filter(words, lambda x: ~x["k"].isin(list(fillers)))), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["k"] == "") | (x["k"] != F.get(all_, i - 1)["k"])))[0]
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def first_of_equals(parts: Column, key: Callable[[Column], Column] = lambda p: p) -> Column:
    """Parts less those whose key an earlier one has; a part with an empty key stays."""
    keyed = F.transform(parts, lambda p: F.struct(p.alias("p"), key(p).alias("k")))
    # The outer transform binds the parts and their keys once for all of their numbers.
    bound = F.transform(F.array(F.struct(keyed.alias("parts"), F.transform(parts, lambda p: key(p)).alias("keys"))), lambda b: F.filter(b["parts"], lambda x, i: (x["k"] == "") | (F.array_position(b["keys"], x["k"]) == i + 1)))[0]
    return F.transform(bound, lambda x: x["p"])


def focused_sections(c: Column, terms: Sequence[str]) -> Column:
    """Blocks (at blank lines, and lines where there are none) that hold a term, each once, whatever its case, spaces and marks."""
    blocks = F.filter(F.split(c, "\n[ \t]*\n+|\n"), lambda b: F.trim(b) != "")
    hit = lambda b: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(b), t))
    return first_of_equals(F.filter(blocks, hit), lambda b: F.regexp_replace(F.lower(b), r"[^\p{L}\p{N}]", ""))


def correct_outside(c: Column, table: Mapping[str, str], protected: str) -> Column:
    """replace_all() on what the pattern ``protected`` does not match; what it matches stays. The pattern has no groups."""
    spans = F.regexp_extract_all(c, F.lit(f"({protected})"), F.lit(1))
    between = F.split(c, protected, -1)
    out = F.transform(between, lambda b, i: F.concat(replace_all(b, table), F.coalesce(F.get(spans, i), F.lit(""))))
    return F.array_join(out, "")


def overlapping(chunks: Column, size: int) -> Column:
    """Chunks that begin with the last whole lines of the one before, as many as fit in ``size`` characters."""
    empty = F.struct(F.lit("").alias("tail"), F.lit(True).alias("open"))

    def longer(state: Column, line: Column) -> Column:
        more = F.when(state["tail"] == "", line).otherwise(F.concat(line, F.lit("\n"), state["tail"]))
        fits = state["open"] & (F.length(more) <= size)
        return F.struct(F.when(fits, more).otherwise(state["tail"]).alias("tail"), fits.alias("open"))

    tail = lambda t: F.aggregate(F.reverse(F.split(t, "\n")), empty, longer, lambda s: s["tail"])
    # The outer transforms bind the chunks, and then their tails, once for all of their numbers.
    tailed = lambda x, t: F.when(F.coalesce(t, F.lit("")) == "", x).otherwise(F.concat(t, F.lit("\n"), x))
    both = F.transform(F.array(chunks), lambda all_: F.struct(all_.alias("chunks"), F.transform(all_, lambda x: tail(x)).alias("tails")))
    return F.transform(both, lambda b: F.transform(b["chunks"], lambda x, i: tailed(x, F.when(i > 0, F.get(b["tails"], i - 1)))))[0]


def weighted_choice(weights: Mapping[str, float], seed: int, *columns: str) -> Column:
    """A label by weight, from a hash of the seed and the columns: a row's choice does not depend on any other."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out, total, last = F, 0.0, list(weights)[-1]
    for label, weight in list(weights.items())[:-1]:
        total += weight
        out = out.when(number < total, label)
    return out.otherwise(last)


def gaussian(key: Column, mean: float, deviation: float) -> Column:
    """A number drawn from a normal distribution by a hash of the key (a text): two uniform numbers from its digits, turned by Box and Muller."""
    part = lambda at: F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("long")
    one, two = (part(1) + 1) / F.lit(4294967297.0), part(9) / F.lit(4294967296.0)
    return mean + deviation * F.sqrt(-2 * F.ln(one)) * F.cos(2 * F.pi() * two)


def fragments(c: Column, seed: Column, least: int = 10, most: int = 60) -> Column:
    """(fragment, text): a text cut after lengths from a normal distribution, clipped to ``least`` and ``most`` characters."""
    number = F.sequence(F.lit(0), F.floor(F.length(c) / least).cast("int"))
    size = lambda i: F.greatest(F.lit(least), F.least(F.lit(most), F.floor(gaussian(F.concat_ws(":", seed, i.cast("string")), (least + most) / 2, (most - least) / 4)))).cast("int")
    start = F.struct(F.lit(0).alias("before"), F.array().cast("array<struct<fragment:int,text:string>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        more = F.array_append(s["out"], F.struct(i.alias("fragment"), F.substring(c, s["before"] + 1, size(i)).alias("text")))
        return F.when(s["before"] >= F.length(c), s).otherwise(F.struct((s["before"] + size(i)).alias("before"), more.alias("out")))

    return F.aggregate(number, start, step, lambda s: s["out"])


def last_weekdays(df: DataFrame, day: str, n: int) -> DataFrame:
    """day: the n weekdays up to each date in a column of df."""
    days = F.filter(F.sequence(F.date_sub(day, 2 * n + 4), F.col(day)), lambda x: F.weekday(x) < 5)
    return df.select(F.explode(F.slice(F.reverse(days), 1, n)).alias("day"))


def dates(c: str) -> Column:
    """Dates in a text, in order, written with - or / or . between year, month and day; what is no date is left out."""
    found = F.regexp_extract_all(F.col(c), F.lit(r"([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2})"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[/.]", "-").try_cast("date")), lambda x: x.isNotNull())


def snippet(c: Column, terms: Sequence[str], before: int = 20, length: int = 60) -> Column:
    """A stretch of the text around the first occurrence of any of the terms, whatever its case; null where there is none."""
    places = [F.nullif(F.instr(F.lower(c), F.lit(t.lower())), F.lit(0)) for t in terms]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNotNull(), F.substring(c, F.greatest(F.lit(1), first - before), F.lit(length)))


REDACTIONS = (
    (r"https?://[^ \t\n]+", "[URL]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"\+?[0-9][0-9() -]{7,}[0-9]", "[PHONE]"),
)


def redact(c: Column) -> Column:
    for pattern, tag in REDACTIONS:
        c = F.regexp_replace(c, pattern, tag)
    return c


def normalise_masks(c: Column, mark: str = r"\*") -> Column:
    """Runs of mask characters become tags by their length: 16, 12 to 15, 11, 10, and 3 or more of the rest."""
    for low, high, tag in ((16, 16, "[CARD]"), (12, 15, "[ACCOUNT]"), (11, 11, "[MOBILE]"), (10, 10, "[NUMBER]")):
        c = F.regexp_replace(c, rf"(?<!{mark}){mark}{{{low},{high}}}(?!{mark})", tag)
    return F.regexp_replace(c, rf"{mark}{{3,}}", "[MASK]")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \n]+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def pack(parts: Column, size: int, joiner: str = " ") -> Column:
    """Parts joined greedily up to ``size`` characters; a longer part is a chunk of its own. A fold inside the row."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, part: Column) -> Column:
        longer = F.concat(state["open"], F.lit(joiner), part)
        fits = F.length(longer) <= size
        return F.struct(
            F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
            F.when(state["open"].isNull(), part).when(fits, longer).otherwise(part).alias("open"),
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def section_chunks(c: Column, tokens: int) -> Column:
    """(heading, text) chunks: sections at lines that begin with #, paragraphs at blank lines, packed up to a token budget.

    A token is four characters. A paragraph over the budget is packed by sentences, and a sentence over it is cut.
    """
    size = 4 * tokens
    cut = lambda s: F.regexp_extract_all(s, F.lit(f"((?s).{{1,{size}}})"), F.lit(1))
    small = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(pack(F.flatten(F.transform(sentences(p), cut)), size))

    def chunks(section: Column) -> Column:
        heading = F.regexp_extract(section, r"^#+ *([^\n]*)", 1)
        body = F.when(section.startswith("#"), F.regexp_replace(section, r"^[^\n]*\n?", "")).otherwise(section)
        paragraphs = F.filter(F.split(body, r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")
        return F.transform(pack(F.flatten(F.transform(paragraphs, small)), size, "\n\n"), lambda x: F.struct(heading.alias("heading"), x.alias("text")))

    return F.flatten(F.transform(F.split(c, r"\n(?=#)"), chunks))


def _nested(change) -> Callable[[Column], Column]:
    """A pandas UDF of JSON texts: what ``change`` makes of the value; null where it is no JSON or nothing is left."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                value = change(json.loads(t)) if t is not None else None
            except ValueError:
                value = None
            out.append(None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return run


def json_pruned(c: Column) -> Column:
    """Without nulls, empty texts, and lists and objects that are empty or become so, at every depth."""

    def prune(x):
        if isinstance(x, dict):
            x = {k: v for k, v in ((k, prune(v)) for k, v in x.items()) if v is not None}
        elif isinstance(x, list):
            x = [v for v in map(prune, x) if v is not None]
        elif isinstance(x, str):
            x = x.strip()
        return None if x is None or x in ("", [], {}) else x

    return _nested(prune)(c)


def json_without(c: Column, phrases: Sequence[str]) -> Column:
    """Without the phrases in any text, keys aside, at every depth."""

    def out(x):
        if isinstance(x, dict):
            return {k: out(v) for k, v in x.items()}
        if isinstance(x, list):
            return [out(v) for v in x]
        if isinstance(x, str):
            for p in sorted(phrases, key=len, reverse=True):
                x = x.replace(p, "")
            return " ".join(x.split())
        return x

    return _nested(out)(c)


def json_objects(c: Column) -> Column:
    """The whole objects of the first JSON array in a text; of one that is cut off, those before the cut."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        decoder, out = json.JSONDecoder(), []
        for t in texts:
            found, at = [], (t or "").find("[") + 1
            while at:
                at = t.find("{", at)
                try:
                    value, end = decoder.raw_decode(t, at) if at >= 0 else (None, 0)
                except ValueError:
                    break
                if value is None:
                    break
                found.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
                at = end
                if t[at:].lstrip()[:1] == "]":
                    break
            out.append(found)
        return pd.Series(out)

    return run(c)


def strip_tags(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, with the common entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def number_of_units(c: Column, units: Mapping[str, int]) -> Column:
    """The sum of numbers before unit words, as in "2m 7k" with m and k; digits alone count as they are."""
    total = F.lit(0).cast("long")
    for unit, factor in units.items():
        total = total + F.coalesce(F.regexp_extract(c, rf"(\d+) ?{unit}", 1).try_cast("long"), F.lit(0)) * factor
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long")).otherwise(total)
