"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, those with a telling word are normalised and mapped to identifiers of
known licence sentences: the first pattern that stands anywhere in a sentence counts, so what a sentence
says before and after it doesn't matter. An identifier carries the version that the sentence names and a
plus if later ones are allowed. The sequence of identifiers is matched against licence rules in their
order; what a rule has matched is used up. Everything happens within the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without which a sentence is none of a licence.
TELLING = r"licen[sc]|copyright|permission|permitted|redistribut|warrant|spdx|public domain|all rights reserved|free software|general public|liab|merchantab|\bcc[ -]?(?:by|0)\b|creative commons|no rights reserved|\b[al]?gpl|\bwtfpl\b|without warrant|unencumbered"

_V = r"(?:version |v\.? ?|[ -])?([0-9](?:\.[0-9])?)"
_GNU = r"general public licenses?(?: [al]?gpl)?(?:,? (?:as published by the free software foundation,? )?(?:either )?(?:" + _V + r"\b)?)?"

# Fixed values: (identifier, pattern within the normalised sentence), the first that stands in it counts. A
# group of a pattern is the version.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("SpdxId", r"spdx[ -]license[ -]identifier [a-z0-9]"),
    ("ApacheAsIs", r"software distributed under the license is distributed on an as is basis"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheSee", r"see the license for the specific language governing permissions"),
    ("Apache", r"apache(?: software)? license[ ,]*" + _V + r"\b"),
    ("Apache", r"apache-([0-9]\.[0-9])\b"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheTerms", r"terms and conditions for use, reproduction, and distribution"),
    ("Apache", r"(?:under|terms of) the apache(?: software)? license"),
    ("GplReceived", r"you should have received a copy of the gnu .*general public license"),
    ("GplNoWarranty", r"distributed in the hope that it will be useful"),
    ("Agpl", r"(?:under|terms of|gnu) (?:the )?(?:gnu )?affero " + _GNU),
    ("Lgpl", r"(?:under|terms of|gnu) (?:the )?(?:gnu )?(?:lesser|library) " + _GNU),
    ("Gpl", r"(?:under|terms of|gnu) (?:the )?(?:gnu )?" + _GNU),
    ("Agpl", r"(?:under|terms of) (?:the )?(?:gnu )?agpl" + _V + r"\b"),
    ("Lgpl", r"(?:under|terms of) (?:the )?(?:gnu )?lgpl" + _V + r"\b"),
    ("Gpl", r"(?:under|terms of) (?:the )?(?:gnu )?gpl" + _V + r"\b"),
    ("CcByNcSa", r"(?:cc[ -]by-nc-sa|attribution-noncommercial-sharealike)(?:[ -]([0-9]\.[0-9]))?"),
    ("CcByNcNd", r"(?:cc[ -]by-nc-nd|attribution-noncommercial-noderiv[a-z]*)(?:[ -]([0-9]\.[0-9]))?"),
    ("CcByNc", r"(?:cc[ -]by-nc|attribution-noncommercial)(?:[ -]([0-9]\.[0-9]))?"),
    ("CcBySa", r"(?:cc[ -]by-sa|attribution-sharealike)(?:[ -]([0-9]\.[0-9]))?"),
    ("CcByNd", r"(?:cc[ -]by-nd|attribution-noderiv[a-z]*)(?:[ -]([0-9]\.[0-9]))?"),
    ("CcBy", r"(?:\bcc[ -]by|creative commons attribution)(?: license)?(?:[ -]([0-9]\.[0-9]))?"),
    ("Cc0", r"\bcc0\b|no rights reserved|creative commons zero"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("Unlicense", r"(?:under|terms of) the unlicense\b"),
    ("Mpl", r"mozilla public license[ ,]*(?:" + _V + r"\b)?"),
    ("Epl", r"eclipse public license[ ,-]*(?:" + _V + r"\b)?"),
    ("Eupl", r"european union public licen[sc]e[ ,]*(?:" + _V + r"\b)?"),
    ("Cddl", r"common development and distribution license[ ,]*(?:\(cddl\) ?)?(?:" + _V + r"\b)?"),
    ("Artistic", r"artistic license[ ,]*(?:" + _V + r"\b)?"),
    ("Ofl", r"sil open font license[ ,]*(?:" + _V + r"\b)?"),
    ("Bsl", r"boost software license[ ,-]*(?:" + _V + r"\b)?"),
    ("Wtfpl", r"do what the f[a-z*]+ you want to public license|\bwtfpl\b"),
    ("Python", r"(?:psf|python software foundation) license"),
    ("BslGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("MitGrant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("MitNotice", r"above copyright notice and this permission notice shall be included in all copies"),
    ("IscGrant", r"permission to use,? copy,? modify,? and/?o?r? ?distribute this software (?:and its documentation )?for any purpose.*appear in all copies"),
    ("ZeroGrant", r"permission to use,? copy,? modify,? and/?o?r? ?distribute this software (?:and its documentation )?for any purpose"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("ZlibAltered", r"altered source versions must be plainly marked"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("Mit", r"(?:^|(?:under|by|terms of|provided|released|the) (?:an? |the )?(?:terms of the )?)(?:mit|expat)(?:[ /-]x11)?(?:[- ]style)? license"),
    ("Isc", r"(?:under|terms of) (?:an? |the )?(?:terms of the )?isc license"),
    ("Zlib", r"(?:under|terms of) (?:an? |the )?(?:terms of the )?zlib(?:/libpng)? license"),
    ("Bsd3", r"(?:bsd[ -]3[ -]clause|(?:3-clause|new|modified|revised) bsd|bsd-new)"),
    ("Bsd2", r"(?:bsd[ -]2[ -]clause|(?:2-clause|simplified|freebsd) bsd|bsd-simplified)"),
    ("Bsd", r"(?:under|terms of) (?:an? |the )?(?:terms of the )?(?:(?:original|4-clause) )?bsd(?:[- ]style)? license"),
    ("BsdRedistribute", r"redistribution and use in source and binary forms.*are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdName", r"be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAdvertising", r"all advertising materials mentioning features or use of this software must display"),
    ("PublicDomain", r"(?:released|placed|dedicated|is|are) (?:into |in |to |under )?the public domain"),
    ("AsIs", r"provided (?:by the copyright holders and contributors )?as[ -]is,? (?:and )?(?:without|any express)"),
    ("NoLiability", r"in no event (?:shall|will) .* be (?:held )?liable"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (?:\(?c\)? ?)?[0-9]{4}"),
)

# Fixed values: (licence, sequence of identifiers), matched in this order. A name in parentheses may be missing.
# The first identifier's version stands for the star; a plus stands for -or-later.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-*", ("Apache", "(ApacheUse)", "(ApacheTerms)", "(ApacheCopy)", "(ApacheAsIs)", "(ApacheSee)")),
    ("Apache-2.0", ("ApacheUse", "ApacheCopy", "(ApacheAsIs)", "(ApacheSee)")),
    ("AGPL-*", ("Agpl", "(GplNoWarranty)", "(GplReceived)")),
    ("LGPL-*", ("Lgpl", "(GplNoWarranty)", "(GplReceived)")),
    ("GPL-*", ("Gpl", "(GplNoWarranty)", "(GplReceived)")),
    ("CC-BY-NC-SA-*", ("CcByNcSa",)),
    ("CC-BY-NC-ND-*", ("CcByNcNd",)),
    ("CC-BY-NC-*", ("CcByNc",)),
    ("CC-BY-SA-*", ("CcBySa",)),
    ("CC-BY-ND-*", ("CcByNd",)),
    ("CC-BY-*", ("CcBy",)),
    ("CC0-1.0", ("Cc0",)),
    ("BSD-4-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdAdvertising", "(BsdName)", "(AsIs)", "(NoLiability)")),
    ("BSD-3-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdName", "(AsIs)", "(NoLiability)")),
    ("BSD-2-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "(AsIs)", "(NoLiability)")),
    ("MIT", ("(Mit)", "(Copyright)", "MitGrant", "(MitNotice)", "(AsIs)", "(NoLiability)")),
    ("MIT", ("Mit", "(MitNotice)", "(AsIs)")),
    ("BSD-3-Clause", ("Bsd3",)),
    ("BSD-2-Clause", ("Bsd2",)),
    ("BSD", ("Bsd",)),
    ("ISC", ("(Isc)", "IscGrant", "(AsIs)", "(NoLiability)")),
    ("ISC", ("Isc",)),
    ("0BSD", ("ZeroGrant", "(AsIs)", "(NoLiability)")),
    ("Zlib", ("(Zlib)", "(AsIs)", "(NoLiability)", "ZlibGrant", "(ZlibOrigin)", "(ZlibAltered)", "(ZlibNotice)")),
    ("Zlib", ("Zlib",)),
    ("MPL-*", ("Mpl",)),
    ("EPL-*", ("Epl",)),
    ("EUPL-*", ("Eupl",)),
    ("CDDL-*", ("Cddl",)),
    ("Artistic-*", ("Artistic",)),
    ("OFL-*", ("Ofl",)),
    ("BSL-1.0", ("(Bsl)", "BslGrant", "(AsIs)", "(NoLiability)")),
    ("BSL-*", ("Bsl",)),
    ("WTFPL", ("Wtfpl",)),
    ("PSF-2.0", ("Python",)),
    ("Unlicense", ("Unlicense", "(AsIs)", "(NoLiability)")),
    ("Public-Domain", ("PublicDomain",)),
    ("SPDX", ("SpdxId",)),
    ("Proprietary", ("AllRights",)),
)
#: Words that allow later versions.
LATER = r"any later version|or later|or newer|[0-9]\+"
BREAK = "\u0001"
#: A tag and its expression; identifiers are what AND, OR, parentheses and exceptions leave of it.
ONE = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
TAG = rf"(?i)spdx[ -]licen[sc]e[ -]identifier[ \t]*:?[ \t]*({ONE}(?:[ \t]+(?:and|or|with)[ \t]+{ONE})*)"


#: Words that a wrapped line may end in: what follows belongs to its sentence.
WRAPPED = "the|of|under|by|or|and|an|a|gnu|to|in|this|that|with|for|either|is|are"


def sentences(text: Column) -> Column:
    """Ends of sentences, empty lines, and line ends before a capital letter divide; not after "v.", nor
    where a notice goes on."""
    cut = F.regexp_replace(text, r"((?<!\b[vV])[.]|[!?]|;(?!\s+(?i:either\s+version)))\s+", "$1" + BREAK)
    cut = F.regexp_replace(cut, r"\n[ \t\r]*\n\s*", BREAK)
    cut = F.regexp_replace(cut, rf"(?<!\b(?i:{WRAPPED})[ \t]{{0,9}})\n[ \t]*(?!\(at your option)([A-Z(])", BREAK + "$1")
    return F.split(cut, BREAK)


def normalised(sentence: Column) -> Column:
    s = F.regexp_replace(F.lower(sentence), "licence", "license")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.,/+-]+", " "), " ,", ",")
    return F.regexp_replace(s, r"^[ .,/*-]+|(?<![ .,/-])[ .,/-]+$", "")


def identifier(norm: Column) -> Column:
    """The first known sentence that stands in norm, its version and plus if it has them; Unknown if none."""
    out = None
    for name, pattern in SENTENCES:
        if ".*" in pattern:  # the first place that the opening fits is tried and no other, so long sentences cost
            opening, rest = pattern.split(".*")  # their length; what is left to look in is longest there
            pattern = f"^(?>.*?{opening}).*{rest}"
        known = F.lit(name)
        if "([0-9]" in pattern:
            version = F.regexp_replace(F.regexp_extract(norm, pattern, 1), "^([0-9])$", "$1.0")
            known = F.concat(F.lit(name), version, F.when((version != "") & norm.rlike(LATER), "+").otherwise(""))
        fits = norm.rlike(pattern)
        out = F.when(fits, known) if out is None else out.when(fits, known)
    return out.otherwise("Unknown")


def rule_pattern(sequence: tuple[str, ...]) -> str:
    """Identifiers in a row, each ending in a comma; unknown sentences may stand between. Group 1 is the
    version of the first."""
    parts = []
    for k, s in enumerate(sequence):
        name = f"{s.strip('()')}{'([0-9.]*[+]?)' if k == 0 else '[0-9.]*[+]?'},"
        parts.append(f"(?:{name}(?:Unknown,)*)?" if s[0] == "(" else f"{name}(?:Unknown,)*")
    parts[-1] = parts[-1].replace("(?:Unknown,)*", "")
    return "(?<![A-Za-z0-9.+])" + "".join(parts)


def license_name(k: Column, version: Column) -> Column:
    """The name of rule k with its version."""
    names = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(RULES) for x in (str(i), n)])
    later, number = version.endswith("+"), F.regexp_replace(version, "[+]", "")
    full = F.regexp_replace(names[k], "[*]", number)
    full = F.when(names[k].endswith("*") & (number == ""), F.regexp_replace(names[k], "-[*]", "")).otherwise(full)
    return F.concat(full, F.when(names[k].endswith("*") & later & names[k].rlike("GPL"), "-or-later").otherwise(""))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, licenses (distinct names in order of the rules, then those of
    SPDX tags in text order, joined by commas), sequence (identifiers of telling sentences in text order)
    and n_unknown, how many of these are no known sentence.

    The whole text is read. Null and empty texts, and texts without a telling word, have empty results.
    Rows are independent; repeated rows and null ids come back as they are, an empty table is empty; other
    columns are not read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    df = docs.select(docs[id_col].alias("id"), text.alias("t"))
    telling = F.filter(sentences(F.col("t")), lambda s: F.lower(s).rlike(TELLING))
    df = df.select("id", F.when(F.lower("t").rlike(TELLING), telling).otherwise(F.array().cast("array<string>")).alias("found"))
    tags = F.flatten(F.transform("found", lambda s: F.regexp_extract_all(s, F.lit(TAG), F.lit(1))))
    ids = F.flatten(F.transform(tags, lambda x: F.split(F.regexp_replace(x, r"(?i)\s+with\s+[^\s()]+", ""), r"[()\s]+")))
    df = df.select("id", F.transform("found", lambda s: identifier(normalised(s))).alias("ids"), F.filter(ids, lambda x: ~F.lower(x).isin("", "and", "or")).alias("tags"))
    seq = F.concat(F.array_join("ids", ","), F.when(F.size("ids") > 0, ",").otherwise(""))
    df = df.select("id", "ids", "tags", seq.alias("seq"))
    left = F.col("seq")
    for k, (_, sequence) in enumerate(RULES):
        left = F.regexp_replace(left, rule_pattern(sequence), f"<{k}:$1>,")
    df = df.select("id", "ids", "tags", F.when(F.size("ids") > 0, left).otherwise("").alias("left"))
    hit = F.array_sort(F.transform(F.regexp_extract_all("left", F.lit("<([0-9]+:[0-9.+]*)>"), F.lit(1)), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("k"), F.split(x, ":")[1].alias("v"))))
    named = F.filter(F.transform(hit, lambda h: license_name(h["k"].cast("string"), h["v"])), lambda n: (n != "SPDX") | (F.size("tags") == 0))
    return df.select(
        F.col("id").alias(id_col), F.array_join(F.array_distinct(F.concat(named, "tags")), ",").alias("licenses"),
        F.array_join("ids", ",").alias("sequence"), F.size(F.filter("ids", lambda x: x == "Unknown")).cast("long").alias("n_unknown"),
    )
