"""Scalar text operators as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, patterns and replacements that results depend on.
INVISIBLES = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
ASCII_QUOTES = (
    ("\u201c", '"'), ("\u201d", '"'), ("\u2018", "'"), ("\u2019", "'"), ("\u00ab", '"'), ("\u00bb", '"'),
    ("\u2013", "-"), ("\u2014", "--"), ("\u2026", "..."),
)
# Blanks that don't end a line, and all blanks, spelled out: Java's Unicode classes are several times slower.
_B = r"[\t\x0B\f\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_W = r"[\n\t\x0B\f\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = "".join(map(chr, [10, 9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
COPYRIGHT_LINES = (
    rf"copyright{_B}*[©Ⓒⓒ(c)]{_B}*\p{{Nd}}{{4}}",
    r"all rights reserved",
    rf"published by{_B}+",
    rf"isbn(?:{_B}|[:\-])*[\p{{Nd}}xX\-]+",
    rf"printed in{_B}+",
    r"library of congress",
    r"first (?:edition|printing)",
    r"cover (?:design|art|illustration)",
    rf"\p{{Nd}}+{_B}*©{_B}*",
)
TOC_LINE = rf"{_B}*chapter{_B}+[\p{{Nd}}IVXLC]+(?:{_B}|[.:])*\p{{Nd}}+{_B}*"
SCENE_BREAK = (
    rf"{_B}*(?:[*\-=~#]{{3,}}|\*{_B}+\*{_B}+\*|[•·]{_B}*[•·]{_B}*[•·]"
    rf"|⁂⁂⁂|[⁂⁑⁕⁖]){_B}*"
)
# What a text must hold for the pass to find anything.
_BREAK_SIGNS = ("***", "---", "===", "~~~", "###", "*", "•", "·", "⁂", "⁑", "⁕", "⁖")
EPIGRAPH_LINE = (
    "^(\\s*[\"\u201c\u201d\u2018\u2019].+[\"\u201c\u201d\u2018\u2019]\\s*|\\s*\u2014.+)$"
)
SENTENCE_BREAK = r"""(?<=[.!?])["')\]]*\s+(?=[A-Z"'(\[])"""
ORNAMENT = (
    r"^(\*{3,}|\*(?:\s+\*){2,}|-{3,}|={3,}|~{3,}|#{3,}|[\u2022\u00b7](?:\s*[\u2022\u00b7]){2,}|[\u2042\u2051\u2055\u2056])$"
)
OPENING_QUOTES = "\"\u201c\u2018\u00ab\u300e\u300c"
CLOSING_QUOTES = "\"\u201d\u2019\u00bb\u300f\u300d"
ATTRIBUTION = "^\\s*[\u2014\u2013-]\\s*\\S+"
BRACKETED = r"\s\[[^\]]+\]"
ENTITY = r"&(?:#\d+|#x[\da-fA-F]+|[a-zA-Z]+);"

# Private-use marks for lines that a pass must remember; they never leave this module.
_KEEP, _TOC, _RUN = "\ue000", "\ue001", "\ue002"
EPIGRAPH_LINES = 20


def strip(c: Column) -> Column:
    """Without blanks at both ends, Unicode blanks included."""
    return F.btrim(c, F.lit(_BLANKS))


def words(c: Column) -> Column:
    """Runs of non-blank characters, Unicode blanks included."""
    return F.filter(F.split(c, f"{_W}+"), lambda w: w != "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _holds(c: Column, signs: Sequence[str]) -> Column:
    """Whether a text holds any of some strings: a cheap look before an expensive pass."""
    out = F.lit(False)
    for x in signs:
        out |= F.contains(c, F.lit(x))
    return out


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def replace_nbsp(c: Column) -> Column:
    return F.translate(c, "\u00a0", " ")


def strip_invisibles(c: Column) -> Column:
    return F.translate(c, INVISIBLES, "")


def ascii_quotes(c: Column) -> Column:
    for old, new in ASCII_QUOTES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def protect_epigraphs(c: Column) -> Column:
    """Marks the quoted or attributed lines among the first twenty, so that line passes leave them alone."""
    lines = F.split(c, "\n")
    head = F.transform(
        F.slice(lines, 1, EPIGRAPH_LINES),
        lambda x: F.when(x.rlike(EPIGRAPH_LINE), F.concat(F.lit(_KEEP), x)).otherwise(x),
    )
    rest = F.slice(lines, F.lit(EPIGRAPH_LINES + 1), F.greatest(F.size(lines) - EPIGRAPH_LINES, F.lit(0)))
    return F.array_join(F.concat(head, rest), "\n")


def restore_epigraphs(c: Column) -> Column:
    return F.replace(c, F.lit(_KEEP), F.lit(""))


#: Passes as (pattern, replacement); lines end at \n alone.
_PAGE_NUMBER = rf"(?md)^{_B}*\p{{Nd}}{{1,5}}{_B}*(?:\n|\z)"
_LINE_END = rf"(?md)(?<!{_B}){_B}++$"
_COPYRIGHT = rf"(?imd)^{_B}*(?:{'|'.join(COPYRIGHT_LINES)})[^\n]*(?:\n\n?|\z)"
_TOC_RUN = rf"(?imd)^({TOC_LINE})$"
_BREAK = rf"(?md)^{SCENE_BREAK}$"


def drop_page_numbers(c: Column) -> Column:
    """Lines of one to five digits go."""
    return F.regexp_replace(c, _PAGE_NUMBER, "")


def squeeze_blank_lines(c: Column) -> Column:
    ends = lambda x: x.rlike(rf"\n(?<={_B}\n)") | F.substring(x, -1, 1).rlike(_B)  # noqa: E731 (looks at line ends alone)
    cut = bound(c, lambda x: F.when(ends(x), F.regexp_replace(x, _LINE_END, "")).otherwise(x))
    return bound(cut, lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x))


def drop_copyright_blocks(c: Column) -> Column:
    """Copyright lines go, with the blank lines right after them."""
    return F.regexp_replace(squeeze_blank_lines(c), _COPYRIGHT, "")


def drop_toc_runs(c: Column) -> Column:
    """Two or more table-of-contents lines in a row go; a lone one stays."""

    def passed(x: Column) -> Column:
        x = F.regexp_replace(x, _TOC_RUN, f"{_TOC}$1")
        x = F.regexp_replace(x, f"{_TOC}[^\\n]*\\n(?={_TOC})", _RUN)
        x = F.regexp_replace(x, f"{_RUN}+{_TOC}[^\\n]*(?:\\n|\\z)", "")
        return F.replace(x, F.lit(_TOC), F.lit(""))

    return bound(c, lambda x: F.when(x.rlike(_TOC_RUN), passed(x)).otherwise(x))


def scene_breaks(c: Column, keep: bool = True) -> Column:
    """Ornament lines become ``***``, or empty lines."""
    return bound(c, lambda x: F.when(_holds(x, _BREAK_SIGNS), F.regexp_replace(x, _BREAK, "***" if keep else "")).otherwise(x))


def normalise_blanks(c: Column) -> Column:
    """No blanks at line ends, one empty line at most, one newline at the end."""
    return F.concat(strip(squeeze_blank_lines(c)), F.lit("\n"))


def clean(c: Column, ascii_marks: bool = False, keep_breaks: bool = True) -> Column:
    """The built-in passes in their fixed order (NFC and entities come before, see ``functions.unicode``)."""
    c = strip_invisibles(replace_nbsp(c))
    c = ascii_quotes(c) if ascii_marks else c
    c = drop_page_numbers(protect_epigraphs(c))
    c = scene_breaks(drop_toc_runs(drop_copyright_blocks(c)), keep_breaks)
    return restore_epigraphs(normalise_blanks(c))


def cleaning_counts(c: Column, ascii_marks: bool = False) -> Column:
    """How often each pass of ``clean`` finds something, as a struct of counts; ``c`` is the text before entities are decoded.

    Page numbers, copyright lines, contents lines and scene breaks are lines; the rest are characters or entities.
    """
    less = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("long")
    quotes, toc = "".join(old for old, _ in ASCII_QUOTES), rf"(?imd)^{TOC_LINE}$"

    def counted(x: Column, plain: Column, seen: Column, own: Column, numbered: Column, printed: Column, listed: Column) -> Column:
        none = F.lit(0).cast("long")
        counts = {
            "entities": count(x, ENTITY), "page_numbers": count(own, _PAGE_NUMBER), "copyright_lines": count(squeeze_blank_lines(numbered), _COPYRIGHT),
            "toc_lines": count(printed, toc) - count(listed, toc), "quotes": less(seen, F.translate(seen, quotes, "")) if ascii_marks else none,
            "nbsp": less(x, F.translate(x, "\u00a0", "")), "invisibles": less(plain, seen), "scene_breaks": count(listed, _BREAK),
        }
        return F.struct(*[n.alias(name) for name, n in counts.items()])

    passes = (
        replace_nbsp, strip_invisibles, lambda x: protect_epigraphs(ascii_quotes(x) if ascii_marks else x), drop_page_numbers,
        drop_copyright_blocks, drop_toc_runs,
    )

    def after(*texts: Column) -> Column:
        """Binds the text after each pass in turn."""
        k = len(texts) - 1
        return counted(*texts) if k == len(passes) else bound(passes[k](texts[-1]), lambda x: after(*texts, x))

    return bound(c, lambda x: after(x))


def is_content_chapter(c: Column) -> Column:
    return (F.length(strip(c)) >= 50) & (word_count(c) >= 15)


def filename_stem(c: Column, default: str = "book") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^_+|_+$", ""), F.lit("")), F.lit(default))


def title_of_id(c: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(c, "_[0-9a-f]{8}$", ""), F.lit("_"), F.lit(" ")))


def chapter_title(text: Column, number: Column) -> Column:
    """The first line with text, if it is short and looks like no sentence; else ``Chapter n``."""
    first = strip(F.get(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), F.lit(0)))
    fits = (F.length(first) < 80) & ~F.substring(first, -1, 1).isin(".", "!", "?", ":") & ~first.rlike("[*#]")
    return F.when(fits, first).otherwise(F.concat(F.lit("Chapter "), number.cast("string")))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Stripped sentences; a paragraph without any gives itself."""
    parts = F.filter(F.transform(F.split(c, SENTENCE_BREAK), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(c)))


def keywords(c: Column) -> Column:
    """Words of three letters or more for ranking; repeats stay."""
    found = F.regexp_extract_all(c, F.lit("([A-Za-z0-9][A-Za-z0-9'\u2019-]+)"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda w: F.length(w) > 2)


def match_form(c: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def quote_matches(text: Column, quote: Column) -> Column:
    """Verbatim, or with blanks collapsed, or so in lower case; an empty quote never."""
    squeezed = [strip(F.regexp_replace(x, f"{_W}+", " ")) for x in (text, quote)]
    lower = [F.lower(x) for x in squeezed]
    found = F.contains(text, quote) | F.contains(*squeezed) | F.contains(*lower)
    return F.coalesce((F.length(strip(quote)) > 0) & found, F.lit(False))


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, BRACKETED, "")


def bracketed(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def shortened(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def result_text(description: Column, name: Column, text: Column, whole: Column) -> Column:
    """The first that isn't empty; else the whole row as JSON."""
    filled = [F.nullif(x, F.lit("")) for x in (description, name, text)]
    return F.coalesce(*filled, F.to_json(whole))


def mood(book_id: Column, palettes: int = 6) -> Column:
    """A palette's number: the sum of the id's UTF-16 units by ``palettes``; characters beyond 16 bits are two units."""
    codes = F.transform(F.filter(F.split(book_id, ""), lambda x: x != ""), F.ascii)
    beyond = lambda c: F.lit(0xD800 + 0xDC00) + F.shiftright(c - 0x10000, 10) + (c - 0x10000).bitwiseAND(0x3FF)
    units = F.transform(codes, lambda c: F.when(c > 0xFFFF, beyond(c)).otherwise(c))
    return F.aggregate(units, F.lit(0), lambda a, b: a + b) % palettes


def sentence_key(sid: Column) -> Column:
    """(paragraph, sentence) of ``p1.s2``; (0, 0) for anything else. Structs compare in reading order."""
    part = lambda k: F.coalesce(F.regexp_extract(sid, r"^p(\d+)\.s(\d+)$", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("p"), part(2).alias("s"))


def trim_boilerplate(text: Column, start_marker: str, end_marker: str) -> Column:
    """From the line after the start marker to before the end marker, in either case."""
    at = F.locate(start_marker.upper(), F.upper(text))
    body = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    line_end = F.when(at > 0, F.locate("\n", body)).otherwise(F.lit(0))
    body = F.substring(body, line_end + 1, F.length(body))
    end = F.locate(end_marker.upper(), F.upper(body))
    return F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body)


def split_at_headings(text: Column, heading: str = "STAVE", least: int = 200) -> Column:
    """Parts that start with a heading line; the whole text if there are none."""
    parts = F.split(text, rf"(?i)(?=\n\s*{heading}\s+)")
    parts = F.filter(parts, lambda p: (F.length(p) > least) & p.rlike(rf"(?i)^\n\s*{heading}\s+"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def last_error_line(c: Column) -> Column:
    return F.element_at(F.split(strip(c), "\n"), -1)


def safe_int(c: Column) -> Column:
    """An integer, or -1."""
    return F.coalesce(F.regexp_replace(strip(c), "_", "").try_cast("int"), F.lit(-1))


def is_ornament(c: Column) -> Column:
    return strip(c).rlike(ORNAMENT)


def is_epigraph(c: Column, position: Column) -> Column:
    """A short quoted block among a chapter's first three paragraphs."""
    text = strip(c)
    last = strip(F.element_at(F.split(text, "\n"), -1))
    closes = F.contains(F.lit(CLOSING_QUOTES), F.substring(last, -1, 1)) | last.rlike(ATTRIBUTION)
    opens = F.contains(F.lit(OPENING_QUOTES), F.substring(text, 1, 1))
    return (position < 3) & F.length(text).between(1, 600) & opens & closes
