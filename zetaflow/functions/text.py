"""Text functions: tokenizers, edit distance, legibility, snippets, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of English, Italian and French prose.
LEGIBLE_STOPWORDS = tuple(
    """the of and to a in is it you that for on with as are this be at or from by an was we can your all have
    will one but not they his her has had more when which their if there what about out up so them some into than
    then its also how our these
    di e il la che un per è con non si le del i da al come dei nel se della o ma più lo su una questo
    anche ne gli alla poi quando chi due essa ed delle alle
    les des du et en une dans pour que qui sur avec au aux
    ce cette elle pas ou mais son sa ses vous nous je faire bien""".split()
)
# Words no theme is named after.
THEME_STOPWORDS = tuple(
    """the and for with that this are was were not you your from have has had but its can will all one two into when
    then them they their there which what who how why also more some such than these those each other may should would could
    about over under out off our his her she him been being does did just only very much many most any per page chapter""".split()
)
# Bars of legibility.
LEGIBLE_OK, NOISY_MIN = 0.55, 0.45


def default_tokens(text: Column) -> Column:
    """Split at Unicode white space; keep ASCII letters and digits, lower-cased; drop what is left empty.

    Marks are removed from the whole text at once, not word by word.
    """
    kept = F.lower(F.regexp_replace(text, r"(?U)[^A-Za-z0-9\s]", ""))
    return F.array_remove(F.split(kept, r"(?U)\s+"), "")


def core_tokens(text: Column) -> Column:
    """Split at Unicode white space; keep letters and digits of any script, lower-cased; drop tokens of one byte or none."""
    kept = F.lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\p{N}\s]", ""))
    return F.filter(F.split(kept, r"(?U)\s+"), lambda x: F.octet_length(x) > 1)


def lex_tokens(text: Column) -> Column:
    """The tokens a full-text index sees: those of :func:`core_tokens`, by joining and splitting at NUL."""
    return F.array_remove(F.split(F.array_join(core_tokens(text), "\x00"), "\x00"), "")


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of the UTF-8 bytes: each byte stands for a character of its own."""
    as_bytes = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def round5(x: Column) -> Column:
    """Five decimals, half up."""
    return F.floor(x * 1e5 + 0.5) / 1e5


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def term_tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Runs of ASCII letters of 3 to 20, lower-cased, without stopwords."""
    words = F.transform(F.split(text, "[^A-Za-z]"), F.lower)
    keep = F.filter(words, lambda x: F.length(x).between(3, 20))
    return F.filter(keep, lambda x: ~x.isin(*stopwords)) if stopwords else keep


def punctuation_tokens(text: Column) -> Column:
    """Every punctuation mark is a token of its own, runs of other non-blanks are one."""
    return F.regexp_extract_all(text, F.lit(r"([!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+)"), 1)


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or ``most + 1`` beyond it."""
    return F.least(F.levenshtein(a, b), F.lit(most + 1))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate_bytes(text: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters, and an ellipsis if cut."""
    cut = F.reduce(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, i: F.when(F.octet_length(F.substr(text, F.lit(1), i)) <= most, F.least(i, F.length(text))).otherwise(n))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), cut), F.lit("…")))


def snippet(text: Column, most: int) -> Column:
    """The first ``most`` characters, cut at the last blank, with an ellipsis if cut."""
    cut = F.left(text, F.lit(most))
    at_blank = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(at_blank, F.lit("…")))


def base_id(name: Column) -> Column:
    return F.regexp_replace(name, "-[0-9]+$", "")


def is_reserved(name: Column) -> Column:
    return F.startswith(name, F.lit("~"))


def file_kind(path: Column) -> Column:
    """Kind of a file by its extension, whatever its case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "webp", "heic"), "image").when(ext.isin("md", "txt"), "text").when(ext == "epub", "epub")


def shelf(relpath: Column, root: Column | None = None) -> Column:
    """First folder of a path; at the top level the linked root's name, if any."""
    return F.when(F.instr(relpath, "/") > 0, F.split(relpath, "/")[0]).otherwise(root if root is not None else F.lit(None).cast("string"))


def fnv1a(text: Column, page: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, then of a page number, in a long."""
    wrap = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    step = lambda h, c: wrap(h.bitwiseXOR(c) * F.lit(16777619).cast("long"))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return step(F.reduce(codes, F.lit(2166136261).cast("long"), step), page.cast("long"))


def ghost_prefix(query: Column) -> Column:
    """The word being typed: letters and digits at the end, two at least; empty after anything else."""
    return F.lower(F.regexp_extract(query, "([A-Za-z0-9]{2,})$", 1))


def wiki_links(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]]+)\]\]"), 1)


# Characters after which a word begins.
_BOUNDARY = r"^[\s\-_·/(\[.,:;'\"]$"


def subsequence(label: Column, query: Column) -> Column:
    """``struct<score, spans>`` of a query whose characters all stand in the label in order, else null.

    Each is sought from behind the one before, whatever the case; blanks of the
    query are skipped. It counts 18 at the start of the label, 12 at the start of a
    word, 8 next to the one before, else 1 less the characters skipped, 6 at most.
    The whole query in one piece adds 10, each UTF-16 unit of the label takes 0.05.
    Spans (start, end exclusive) are the runs matched, in code points. An empty query: 0, no spans.
    """
    parts = F.struct(F.lower(label).alias("l"), F.lower(F.trim(query)).alias("q"), utf16_length(label).alias("n"))
    no_place = F.array().cast("array<int>")
    seek = lambda l: lambda at, c: F.concat(at, F.array(F.nullif(F.call_function("locate", c, l, F.when(F.size(at) == 0, 1).otherwise(F.element_at(at, -1) + 1)), F.lit(0))))  # noqa: E731, E741
    places = lambda p: F.reduce(F.split(F.replace(p.q, F.lit(" "), F.lit("")), ""), no_place, seek(p.l))

    def score(p: Column, at: Column) -> Column:
        def gain(x: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(at, i - 1))
            word = F.regexp_like(F.substr(p.l, x - 1, F.lit(1)), F.lit(_BOUNDARY))
            return F.when(x == 1, 18).when(word, 12).when((i > 0) & (x == before + 1), 8).otherwise(1 - F.least(x - before - 1, F.lit(6)))

        total = F.reduce(F.transform(at, gain), F.lit(0), lambda a, x: a + x)
        return total + F.when(F.contains(p.l, p.q), 10).otherwise(0) - p.n * 0.05

    def spans(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: (i == 0) | (F.coalesce(F.get(at, i - 1), F.lit(0)) + 1 != x))
        ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1), F.lit(0)) != x + 1)
        return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).alias("start"), b.alias("end")))

    def found(p: Column) -> Column:
        empty = F.struct(F.lit(0.0).alias("score"), spans(no_place).alias("spans"))
        hit = lambda at: F.when(F.forall(at, lambda x: x.isNotNull()), F.struct(score(p, at).cast("double").alias("score"), spans(at).alias("spans")))
        return F.when(p.q == "", empty).otherwise(let(places(p), hit))

    return let(parts, found)


# Legibility.


def words_of(text: Column) -> Column:
    """Words between Unicode blanks."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def legibility(words: Column) -> Column:
    """How much a list of words reads like prose, 0 to 1.

    0.55 for function words (full at 28 percent), 0.20 for word shapes, 0.15 for
    the absence of short fragments (none left at 20 percent) and 0.10 for a mean
    length of 3 to 9.
    """
    trimmed = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")))
    return let(F.array_remove(trimmed, ""), _legibility)


def _legibility(tokens: Column) -> Column:
    """All counts in one pass over the tokens; function words are looked up in a hash set."""
    n = F.size(tokens).cast("double")
    facts = F.transform(tokens, lambda w: F.struct(F.length(w).alias("n"), F.length(F.regexp_replace(w, r"[^\p{IsAlphabetic}]", "")).alias("letters"), w.isin(*LEGIBLE_STOPWORDS).alias("stop"), F.regexp_like(w, F.lit("[aeiouy]")).alias("vowel")))
    one = lambda c: F.when(c, 1).otherwise(0)
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("shaped"), F.lit(0).alias("junk"), F.lit(0).alias("length"))
    add = lambda a, w: F.struct(
        (a.stop + one(w.stop)).alias("stop"),
        (a.shaped + one((w.n <= 20) & (w.letters * 5 >= w.n * 4) & w.vowel)).alias("shaped"),
        (a.junk + one((w.n <= 2) & ~w.stop & (w.letters == w.n))).alias("junk"),
        (a.length + w.n).alias("length"),
    )

    def score(c: Column) -> Column:
        mean = c["length"] / n
        usual = F.when(mean.between(3.0, 9.0), F.lit(1.0)).when(mean < 3.0, mean / 3.0).otherwise(F.greatest(1.0 - (mean - 9.0) / 6.0, F.lit(0.0)))
        return 0.55 * F.least(c["stop"] / n / 0.28, F.lit(1.0)) + 0.20 * (c["shaped"] / n) + 0.15 * (1.0 - F.least(c["junk"] / n / 0.20, F.lit(1.0))) + 0.10 * usual

    return F.reduce(facts, zero, add, lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.least(score(c), F.lit(1.0)), F.lit(0.0))))


def windows(words: Column, size: int = 40, stride: int = 20) -> Column:
    """Overlapping slices; the last is the first to reach the end. One slice of everything if there are at most ``size``."""
    n = F.size(words)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(words, i * stride + 1, size))


def min_window(words: Column, size: int = 40, stride: int = 20) -> Column:
    """The least legible stretch."""
    return F.when(F.size(words) <= size, legibility(words)).otherwise(F.array_min(F.transform(windows(words, size, stride), legibility)))


def legible_excerpt(words: Column, block: int = 20) -> Column:
    """Blocks that read like prose; neighbours are joined by a blank, gaps by an ellipsis."""
    count = F.greatest(F.ceil(F.size(words) / block).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(words, i * block + 1, block))
    kept = F.transform(parts, lambda p: F.when(legibility(p) >= LEGIBLE_OK, F.array_join(p, " ")).otherwise(F.lit("\x00")))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), "^[\x00 ]+|[\x00 ]+$", ""), "( \x00)+ ", " … ")
