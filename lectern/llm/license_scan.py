"""License scans: canonical digests of entire texts, hash-joined to known licence digests.

A text's canonical form has A-Z in lower case, no lines that state a copyright, everything but a-z and 0-9 as single
blanks, and one spelling for equivalent words; its SHA-256 is looked up. Whole documents are texts, and so is each of
their lines, so that short notices inside a document are found. Up to ``BROADCAST_KNOWN`` known digests (counted first)
are the broadcast side of the join, and documents are never shuffled; more are joined by a shuffle of digests. Texts whose
first word opens no known text aren't hashed, as long as the known texts open with few different words.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.license_texts import TEXTS
from lectern.llm.scratch import Scratch

BROADCAST_KNOWN = 200_000
MAX_OPENINGS = 1_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Words after "copyright" in running text, where a line may break just before it.
_PROSE = (
    "also and are as can date disclaimer doctrine doctrines for has header headers holder holders if in infringement interest interests is law laws"
    " licence license licenses like line management may means notice notices of on or owner owners ownership patent permission"
    " permissions protection resulting rights shall statement statements status term terms that this those to treaties treaty under"
    " which will with"
).split()
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _other(words: Sequence[str], start: bool = True) -> str:
    """A pattern, without lookahead, for any word's start that tells it from these; ends of words need a next character."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    ways = ["[" + "".join(c for c in _LETTERS if c not in tails) + "]"]
    ways += [c + (_other(rest, False) if any(rest) else "[a-z0-9]") for c, rest in sorted(tails.items())]
    if not start and "" not in words:
        ways.append(r"[^a-z0-9\n]")
    return "(" + "|".join(ways) + ")"


#: Lines that state a copyright: a holder, year or sign after the word, (c) with a year, © or the reservation of rights.
COPYRIGHT_LINE = (
    rf"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*[^\x00-\x7f]|copyright[^a-z0-9\n]+{_other(_PROSE)}"
    r"|\(c\)[^a-z0-9\n]*copyright|\(c\)[^\n]*[12][0-9][0-9][0-9]|©|all rights reserved)[^\n]*"
)

# Equivalent spellings.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Public licence texts and the usual one-line notices.
_NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        ' granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS'
        " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE"
        " LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM"
        " LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING"
        " OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See'
        " the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
        "Licensed under the Creative Commons Attribution 4.0 International License.",
    ),
}

_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", '"Simplified BSD License"'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", '"New BSD License"'),
}
_TERMS_END = "END OF TERMS AND CONDITIONS"


def _with_variants(name: str, text: str) -> list[str]:
    """A whole text with and without a title and without the appendix on how to apply it; notices stay alone."""
    out = [text]
    if name in _TITLES and len(text) > 500:
        bare = text.removeprefix(f"{_TITLES[name][0]}\n")
        out += [bare, *[f"{title}\n\n{bare}" for title in _TITLES[name]]]
    if _TERMS_END in text:
        out.append(text[: text.index(_TERMS_END) + len(_TERMS_END)])
    return list(dict.fromkeys(out))


KNOWN: dict[str, tuple[str, ...]] = {
    name: tuple(v for text in (*_NOTICES.get(name, ()), *TEXTS.get(name, ())) for v in _with_variants(name, text))
    for name in sorted({*_NOTICES, *TEXTS})
}


def plain_lines(text: Column) -> Column:
    """Lower case, copyright lines emptied, and runs of other characters than letters, digits and line ends as a blank."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    return F.regexp_replace(out, "[^a-z0-9\n]+", " ")


def one_spelling(plain: Column) -> Column:
    """The canonical form of plain text: single blanks, one spelling."""
    out = F.trim(F.regexp_replace(plain, "[ \n]+", " "))
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return out


def first_word(plain: Column) -> Column:
    return F.regexp_extract(plain, "[a-z0-9]+", 0)


def known_digests(spark: SparkSession, known: Mapping[str, Sequence[str]] | DataFrame = KNOWN) -> DataFrame:
    """(license, digest, opening) of known texts, given as a mapping or as a table of license and text.

    A digest of several licences goes to the first by name.
    """
    if not isinstance(known, DataFrame):
        rows = [(name, text) for name, texts in known.items() for text in texts]
        known = spark.createDataFrame(rows, "license string, text string")
    texts = known.withColumn("c", one_spelling(plain_lines(F.col("text"))))
    return texts.filter("c <> ''").groupBy(F.sha2("c", 256).alias("digest")).agg(
        F.min("license").alias("license"), F.first(first_word(F.col("c"))).alias("opening")
    )


def _openings(digests: DataFrame) -> list[str] | None:
    """First words that a plain text must have to become a known one: theirs, and other spellings of them.

    None if there are so many that looking at them first doesn't pay.
    """
    words = {r["opening"] for r in digests.select("opening").distinct().limit(MAX_OPENINGS + 1).collect()}
    if len(words) > MAX_OPENINGS:
        return None
    while more := {old.split()[0] for old, new in SPELLINGS if new.split()[0] in words} - words:
        words |= more
    return sorted(words)


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: Mapping[str, Sequence[str]] | DataFrame = KNOWN,
) -> DataFrame:
    """A row per text that is a known licence: doc_id, line_no (0: the whole document; else from 1), license, digest.

    Texts whose canonical form is empty match nothing (null, empty, blank and copyright-only texts). A document of one
    line matches as a whole and as its line. Repeated rows give repeated results, ids may be null, an empty table gives no
    rows, and other columns of ``documents`` are ignored.
    """
    digests = Scratch(documents.sparkSession, "licenses").save(known_digests(documents.sparkSession, known))
    openings = _openings(digests)
    opens = lambda c: F.lit(True) if openings is None else first_word(c).isin(*openings)
    docs = documents.select(
        F.col(id_col).alias("doc_id"), plain_lines(F.col(text_col).cast("string")).alias("plain")
    )
    whole = F.filter(F.array(F.struct(F.lit(0).alias("line_no"), F.col("plain").alias("text"))), lambda x: opens(x["text"]))
    numbered = F.transform(F.split("plain", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text")))
    texts = docs.select("doc_id", F.explode(F.concat(whole, F.filter(numbered, lambda x: opens(x["text"])))).alias("x"))
    texts = texts.select("doc_id", "x.line_no", F.sha2(one_spelling(F.col("x.text")), 256).alias("digest"))
    digests = F.broadcast(digests) if digests.count() <= BROADCAST_KNOWN else digests
    return texts.join(digests, "digest").select("doc_id", "line_no", "license", "digest")
