"""Operator 7: license scans with ordered signature rules, in DataFrame expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import read


@dataclass(frozen=True)
class Rule:
    """pattern matches whole words of the normalised text; it is tried only where keyword occurs there, so each match must hold it."""

    name: str
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: The phrases whose places are always reported. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_L = "licen[sc]e"
_V = r"(?:(?:version|ver|v) )?"
#: (label, keyword, name of the license, short identifier as written after an SPDX tag or as a file header).
FAMILIES = [
    ("gpl", "gpl", f"gpl(?: {_V}[123](?: 0)?)?", r"gpl [123](?: 0)?(?: only| or later)?"),
    ("gpl", "gnu", f"gnu (?:general public {_L}|gpl)(?: {_V}[123](?: 0)?)?", r"gnu gpl v?[123](?: 0)?"),
    ("lgpl", "lesser", f"(?:gnu )?lesser general public {_L}(?: {_V}[23](?: [01])?)?", r"lgpl [23](?: [01])?(?: only| or later)?"),
    ("lgpl", "lgpl", r"lgpl(?: v?[23](?: [01])?)?", r"lgpl v?[23](?: [01])?"),
    ("lgpl", "library general", f"(?:gnu )?library general public {_L}", r"lgpl 2 0"),
    ("agpl", "affero", f"(?:gnu )?affero general public {_L}(?: {_V}[13](?: 0)?)?", r"agpl [13](?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", r"agpl(?: v?[13](?: 0)?)?", r"agpl v?[13](?: 0)?"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {_L}(?: {_V}1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("apache", "apache", f"apache(?: software)? {_L}(?: {_V}[12](?: [01])?)?", r"apache [12](?: [01])?"),
    ("mit", "mit licen", f"(?:the )?mit {_L}", r"mit(?: 0)?"),
    ("bsd", "bsd", f"(?:(?:new|modified|simplified|revised|original|[234] clause) )?bsd(?: [234] clause)?(?: style)? {_L}", r"bsd [0-4] clause(?: patent| clear)?"),
    ("isc", "isc", f"isc {_L}", r"isc"),
    ("mpl", "mozilla", f"mozilla public {_L}(?: {_V}[12](?: [01])?)?", r"mpl [12] [01]"),
    ("mpl", "mpl", r"mpl(?: v?[12] [01])", r"mpl v?[12] [01]"),
    ("epl", "eclipse", f"eclipse public {_L}(?: {_V}[12](?: 0)?)?", r"epl [12] 0"),
    ("edl", "eclipse", f"eclipse distribution {_L}", r"edl 1 0"),
    ("cddl", "common development", f"common development and distribution {_L}(?: {_V}1 [01])?", r"cddl 1 [01]"),
    ("cpl", "common public", f"common public {_L}(?: {_V}1 0)?", r"cpl 1 0"),
    ("eupl", "european", f"european union public {_L}(?: {_V}1 [012])?", r"eupl 1 [012]"),
    ("artistic", "artistic", f"artistic {_L}(?: {_V}[12](?: 0)?)?", r"artistic [12] 0(?: perl)?"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}", r"zlib(?: acknowledgement)?"),
    ("libpng", "libpng", f"libpng {_L}", r"libpng(?: 2 0)?"),
    ("boost", "boost", f"boost software {_L}(?: {_V}1 0)?", r"bsl 1 0"),
    ("bsl", "business source", f"business source {_L}(?: {_V}1 [01])?", r"busl 1 1"),
    ("sspl", "server side", f"server side public {_L}(?: {_V}1)?", r"sspl 1 0"),
    ("elastic", "elastic", f"elastic {_L}(?: {_V}[12](?: 0)?)?", r"elastic 2 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("python", "python", f"python software foundation {_L}", r"(?:psf|python) 2 0"),
    ("ruby", "ruby", f"ruby {_L}", r"ruby"),
    ("php", "php", f"php {_L}(?: {_V}3(?: 0?1)?)?", r"php 3 0?1?"),
    ("ofl", "open font", f"(?:sil )?open font {_L}(?: {_V}1 [01])?", r"ofl 1 [01]"),
    ("ms-pl", "microsoft public", f"microsoft public {_L}", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_L}", r"ms rl"),
    ("openssl", "openssl", f"openssl {_L}", r"openssl"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}", r"w3c(?: 19980720| 20150513)?"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}", r"ncsa"),
    ("afl", "academic free", f"academic free {_L}(?: {_V}[123] [012])?", r"afl [123] [012]"),
    ("osl", "open software", f"open software {_L}(?: {_V}[123] [01])?", r"osl [123] [01]"),
    ("odbl", "open data", f"open (?:data commons )?(?:open )?database {_L}", r"odbl 1 0"),
    ("odc-by", "open data commons", f"open data commons attribution {_L}", r"odc by 1 0"),
    ("pddl", "public domain dedication", f"public domain dedication and {_L}", r"pddl 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])", r"cc by [1234] [05]"),
    ("cc-by-sa", "creative commons", f"creative commons attribution share ?alike(?: [1234] [05])?(?: (?:international|unported|generic))?(?: public)?(?: {_L})?", r"cc by sa"),
    ("cc-by-nc", "creative commons", f"creative commons attribution non ?commercial(?: [1234] [05])?(?: (?:international|unported|generic))?(?: {_L})?", r"cc by nc"),
    ("cc-by-nd", "creative commons", f"creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: {_L})?", r"cc by nd"),
    ("cc-by", "creative commons", f"creative commons attribution(?: [1234] [05])?(?: (?:international|unported|generic))?(?: public)?(?: {_L})?", r"cc by"),
    ("cecill", "cecill", f"cecill(?: (?:b|c|[12] [01]))?(?: free software)?(?: {_L}(?: agreement)?)?", r"cecill (?:b|c|[12] [01])"),
    ("postgresql", "postgresql", f"postgresql {_L}", r"postgresql"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?", r"openrail(?: m)?"),
    ("mit", "expat", f"(?:the )?expat {_L}", r"expat"),
    ("mit", "x11", f"(?:the )?x11 {_L}", r"x11"),
]
#: How a name is put in a sentence: (name, priority, pattern with the family's name at {}).
FRAMES = [
    ("named", 1, "{}"),
    ("under", 3, "under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}"),
    ("granted", 4, "(?:licen[sc]ed|released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}"),
    ("versions", 3, "{} or(?: \\(?at your option\\)?| at your option)? any later version"),
]
#: Sentences of license texts.
SENTENCES = [
    ("mit-grant", "mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "mit", "above copyright", "the above copyright notice and this permission notice shall be included"),
    ("isc-grant", "isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd-grant", "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "bsd", "neither the name", "neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors"),
    ("apache-comply", "apache", "in compliance", "you may not use this (?:file|work) except in compliance with the licen[sc]e"),
    ("apache-basis", "apache", "as is basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-free", "gpl", "free software", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl-free", "lgpl", "free software", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("gpl-copy", "gpl", "received a copy", "you should have received a copy of the gnu general public licen[sc]e"),
    ("mpl-header", "mpl", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("unlicense-text", "unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("public-domain", "public-domain", "public domain", "(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("zlib-origin", "zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost-grant", "boost", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("rights", "proprietary", "all rights", "all rights reserved"),
    ("no-copying", "proprietary", "written permission", "without (?:the )?(?:prior )?(?:express )?written permission"),
    ("copyright", "copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("mit-rights", "mit", "without limitation", "without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-warranty", "mit", "fitness", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"),
    ("mit-short", "mit", "mit style", "mit style licen[sc]e"),
    ("isc-warranty", "isc", "the author disclaims", "the author disclaims all warranties with regard to this software"),
    ("bsd-warranty", "bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-advert", "bsd", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-regents", "bsd", "regents", "the regents of the university of california"),
    ("bsd-short", "bsd", "bsd style", "bsd style licen[sc]e"),
    ("bsd-zero", "bsd", "zero clause", "zero clause bsd"),
    ("apache-copy", "apache", "apache org", "(?:you may )?obtain a copy of the licen[sc]e at (?:https? )?(?:www )?apache org licen[sc]es(?: licen[sc]e 2 0)?"),
    ("apache-notice", "apache", "notice file", "see the notice file distributed with this work"),
    ("apache-asf", "apache", "apache software", "licen[sc]ed to the apache software foundation(?: asf)?"),
    ("apache-short", "apache", "asl 2", "asl 2 0"),
    ("gpl-either", "gpl", "gnu general", "either version [123](?: 0)? of the (?:gnu general public )?licen[sc]e or(?: at your option)? any later version (?:(?:(?!either version ).)+? )?gnu general public licen[sc]e"),
    ("gpl-hope", "gpl", "gnu general", "see the gnu general public licen[sc]e for more details"),
    ("gpl-copying", "gpl", "copying", "see (?:the file )?copying (?:file )?for (?:details|licen[sc]e|copying conditions)"),
    ("gpl-fsf", "gpl", "gnu org", "gnu org licen[sc]es(?: gpl(?: 3 0)?)?"),
    ("gpl-classpath", "gpl", "classpath", "classpath exception"),
    ("gpl-dual", "gpl", "dual licen", "dual licen[sc]ed under (?:the )?(?:mit|bsd|apache) and (?:the )?gpl"),
    ("gpl-terms", "gpl", "gpl", "(?:under|with) (?:the )?gpl(?: terms| conditions)?"),
    ("lgpl-copy", "lgpl", "gnu lesser", "received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl-hope", "lgpl", "gnu lesser", "see the gnu lesser general public licen[sc]e for more details"),
    ("lgpl-link", "lgpl", "lgpl", "(?:under|with) (?:the )?lgpl(?: terms| conditions)?"),
    ("agpl-copy", "agpl", "gnu affero", "received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-hope", "agpl", "gnu affero", "see the gnu affero general public licen[sc]e for more details"),
    ("agpl-network", "agpl", "network server", "if you run this software on a network server"),
    ("gfdl-invariant", "gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-copy", "mpl", "mozilla org", "mozilla org mpl(?: 2 0)?"),
    ("mpl-contents", "mpl", "contents of this file", "the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl-tri", "mpl", "mpl", "mpl [12] [01] gpl 2 0 lgpl 2 1"),
    ("epl-copy", "epl", "eclipse org", "eclipse org legal epl v(?:10|20| ?2 0)?"),
    ("epl-program", "epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl-header", "cddl", "cddl", "cddl header (?:start|end)"),
    ("cddl-terms", "cddl", "common development", "subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-terms", "cpl", "common public", "made available under the terms of the common public licen[sc]e"),
    ("eupl-terms", "eupl", "eupl", "licen[sc]ed under the eupl"),
    ("artistic-perl", "artistic", "same terms as perl", "under the same terms as perl(?: 5)? itself"),
    ("zlib-altered", "zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("zlib-asis", "zlib", "express or implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng-notice", "libpng", "libpng", "(?:this code is )?released under the libpng licen[sc]e"),
    ("boost-copy", "boost", "boost org", "boost org licen[sc]e 1 0 txt"),
    ("boost-accompany", "boost", "licen", "see accompanying file licen[sc]e 1 0 txt"),
    ("bsl-change", "bsl", "change date", "change date (?:(?:(?!change date ).)+? )?change licen[sc]e"),
    ("sspl-service", "sspl", "service source code", "make the service source code available"),
    ("commons-clause", "commons-clause", "commons clause", "commons clause licen[sc]e condition"),
    ("unlicense-copy", "unlicense", "unlicense org", "unlicense org"),
    ("wtfpl-text", "wtfpl", "you want to public", "do what the f.?.?k you want to public licen[sc]e"),
    ("beerware", "beerware", "beer", "(?:the )?beer ?ware licen[sc]e"),
    ("beerware-text", "beerware", "a beer", "you can buy me a beer in return"),
    ("python-psf", "python", "psf", "psf licen[sc]e agreement"),
    ("ruby-terms", "ruby", "ruby", "under the same terms as ruby(?: itself)?"),
    ("php-redist", "php", "php", "this product includes php(?: software)?"),
    ("ofl-reserved", "ofl", "reserved font", "with reserved font names?"),
    ("ofl-sil", "ofl", "sil org", "scripts sil org ofl"),
    ("openssl-ack", "openssl", "openssl", "developed by the openssl project"),
    ("w3c-copy", "w3c", "w3c", "w3c ipr software notice"),
    ("cc-url-by", "cc-by", "creativecommons", "creativecommons org licen[sc]es by(?: [1234] [05])?"),
    ("cc-url-by-sa", "cc-by-sa", "creativecommons", "creativecommons org licen[sc]es by sa(?: [1234] [05])?"),
    ("cc-url-by-nc", "cc-by-nc", "creativecommons", "creativecommons org licen[sc]es by nc(?: [1234] [05])?"),
    ("cc-url-by-nd", "cc-by-nd", "creativecommons", "creativecommons org licen[sc]es by nd(?: [1234] [05])?"),
    ("cc-url-zero", "cc0", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-zero-text", "cc0", "cc0", "to the extent possible under law (?:(?:(?!to the extent possible under law ).)+? )?waived all copyright (?:(?:(?!to the extent possible under law ).)+? )?cc0"),
    ("cc-some", "cc-by", "some rights", "some rights reserved creative commons"),
    ("odbl-copy", "odbl", "opendatacommons", "opendatacommons org licen[sc]es odbl"),
    ("pddl-copy", "pddl", "opendatacommons", "opendatacommons org licen[sc]es pddl"),
    ("public-domain-in", "public-domain", "public domain", "(?:is|are) in the public domain"),
    ("public-domain-no", "public-domain", "no copyright", "no copyright is claimed"),
    ("no-warranty", "disclaimer", "without even", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("no-liability", "disclaimer", "in no event", "in no event shall the (?:authors?|copyright holders?)(?: or copyright holders)? be liable"),
    ("confidential", "proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("unauthorized", "proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:(?:(?!unauthori[sz]ed ).)+? )?(?:is )?(?:strictly )?prohibited"),
    ("evaluation", "proprietary", "evaluation", "for evaluation purposes only"),
    ("internal-use", "proprietary", "internal use", "for internal use only"),
    ("eula", "proprietary", "end user", "end user licen[sc]e agreement"),
    ("trade-secret", "proprietary", "trade secrets", "contains trade secrets(?: and proprietary information)?"),
    ("non-commercial", "non-commercial", "non", "(?:for )?non commercial (?:use|purposes) only"),
    ("research-only", "non-commercial", "research", "for (?:academic and )?research (?:use|purposes) only"),
]


def default_rules() -> list[Rule]:
    rules = [Rule(f"base:{label}", label, 2, phrase, phrase, True) for phrase, label in BASE.items()]
    for i, (label, keyword, name, spdx) in enumerate(FAMILIES):
        rules += [Rule(f"{label}:{frame}:{i}", label, priority, keyword, pattern.format(f"(?:{name})")) for frame, priority, pattern in FRAMES]
        rules.append(Rule(f"{label}:spdx:{i}", label, 4, "spdx", f"spdx licen[sc]e identifier (?:{spdx})"))
    return rules + [Rule(f"text:{name}", label, 4 if label not in ("proprietary", "copyright") else 1, keyword, pattern) for name, label, keyword, pattern in SENTENCES]


_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DETECTION = "struct<first_word:int,neg_last:int,neg_priority:int,rule:int,phrase:string>"
#: Weight of the evidence by priority, from 1.
WEIGHTS = (0.5, 0.9, 0.85, 0.98)


#: Parts of words of which most patterns hold one.
GATES = ("licen", "gnu", "gpl", "cc", "software", "copyright", "permission", "warrant", "redistribution", "rights", "domain", "commons", "mpl", "terms", "notice", "source", "purposes", "prohibited", "confidential")


def gate_of(rule: Rule) -> str:
    """A part of a word that each match of the rule holds: one of GATES where what is not optional in its pattern has it."""
    p = rule.pattern
    while (q := re.sub(r"\(\?:[^()]*\)\?|\(\?:[^()]*\|[^()]*\)|\(\?:([^()|]*)\)(?!\?)", lambda m: m[1] or "", p)) != p:
        p = q
    return next((g for g in GATES if g in p), max(rule.keyword.split(" "), key=len))


def _gate(low: str, rules: list[Rule]) -> Column:
    """Cheap test that a text can hold a match of some rule."""
    parts = {gate_of(r) for r in rules}
    parts = sorted(p for p in parts if not any(q != p and q in p for q in parts))
    return F.expr(" or ".join(f"contains({low}, '{p}')" for p in parts) or "false")


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds n_words and detections to docs(doc_id, text): no shuffle, no Python.

    Words are runs of ASCII letters, digits and characters from 128 on, A-Z lower-cased; null text is empty. In
    documents that hold a rule's keyword its pattern is matched at every word; patterns are literals, compiled once a
    task. A detection that lies within another of the same or a higher priority is suppressed, except places of base
    phrases; of equal ones the first rule stays. detections: array of (first_word, last_word, rule, label, priority,
    base, phrase) by place; empty for documents without any. All work on a text grows with its length and with its
    detections to the power of 1.5 at most. Columns of docs stay, but for some of the names n_words and detections,
    which are replaced. An empty table gives none; repeated rows are rows of their own.
    """
    rules = default_rules() if rules is None else rules
    quoted = lambda t: "r'" + t + "'"
    if any("'" in t for r in rules for t in (r.name, r.label, r.keyword, r.pattern)):
        raise ValueError("rules can't hold an apostrophe: it is no character of a word")
    table = F.expr("array(" + ", ".join(f"named_struct('name', {quoted(r.name)}, 'label', {quoted(r.label)}, 'priority', {r.priority}, 'pattern', {quoted(r.pattern)}, 'base', {r.base})" for r in rules) + ")")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kept_columns = [c for c in docs.columns if c not in ("n_words", "detections")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()).alias("_low"))
    out = out.select("_row", F.trim(F.regexp_replace("_low", _BREAK, " ")).alias("_words"))
    spaces = F.length("_words") - F.length(F.replace("_words", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("_words") == "", 0).otherwise(spaces + 1).cast("long")
    out = out.select("_row", n_words.alias("n_words"), F.when(_gate("_words", rules), F.concat(F.lit(" "), "_words", F.lit(" "))).otherwise(F.lit(" ")).alias("_norm"))
    tried: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        tried.setdefault(r.keyword, []).append(f"named_struct('i', {i}, 'phrases', regexp_extract_all(_norm, r' (?=({r.pattern}) )', 1))")
    none = "cast(array() as array<struct<i:int,phrases:array<string>>>)"
    found = F.expr("flatten(array(" + ", ".join(f"if(contains(_norm, ' {k}'), array({', '.join(some)}), {none})" for k, some in tried.items()) + "))") if rules else F.expr(none)
    out = out.withColumn("_found", F.when(F.length("_norm") > 1, F.filter(found, lambda f: F.size(f["phrases"]) > 0)).otherwise(F.expr(none)))
    out = out.withColumn("_rules", table)
    # A match is marked at its first word, so that the words' own indexes tell its place.
    placed = F.expr(
        f"""flatten(transform(_found, f -> zip_with(
            filter(transform(split(substring(regexp_replace(_norm, concat(' (?=', _rules[f.i].pattern, ' )'), ' \u0001'), 2), ' '), (w, k) -> if(startswith(w, '\u0001'), k, -1)), k -> k >= 0),
            f.phrases,
            (k, p) -> cast(named_struct('first_word', k, 'neg_last', -(k + length(p) - length(replace(p, ' ', ''))), 'neg_priority', -_rules[f.i].priority, 'rule', f.i, 'phrase', p) as {_DETECTION}))))"""
    )
    out = out.withColumn("_placed", F.when(F.size("_found") > 0, F.array_sort(placed)).otherwise(F.array().cast(f"array<{_DETECTION}>")))
    # reach[p]: the furthest last word so far of a detection of priority p or more; starts ascend, ends of equal starts
    # descend. Runs of about the root of all detections are folded by themselves, so no array is copied too often.
    most = max((r.priority for r in rules), default=1)
    state = f"named_struct('reach', array_repeat(-1, {most + 1}), 'out', cast(array() as array<{_DETECTION}>))"
    kept = F.expr(
        f"""aggregate(
            transform(sequence(0, (size(_placed) - 1) div cast(ceil(sqrt(size(_placed))) as int)), k -> slice(_placed, k * cast(ceil(sqrt(size(_placed))) as int) + 1, cast(ceil(sqrt(size(_placed))) as int))),
            named_struct('reach', array_repeat(-1, {most + 1}), 'out', cast(array() as array<array<{_DETECTION}>>)),
            (acc, run) -> element_at(transform(array(aggregate(run, named_struct('reach', acc.reach, 'out', {state}.out),
                (at, d) -> named_struct(
                    'reach', transform(at.reach, (x, p) -> if(p <= -d.neg_priority, greatest(x, -d.neg_last), x)),
                    'out', if(_rules[d.rule].base or at.reach[-d.neg_priority] < -d.neg_last, array_append(at.out, d), at.out)))),
                done -> named_struct('reach', done.reach, 'out', array_append(acc.out, done.out))), 1),
            acc -> flatten(acc.out))"""
    )
    shown = F.expr(
        """transform(_kept, d -> named_struct('first_word', cast(d.first_word as long), 'last_word', cast(-d.neg_last as long), 'rule', _rules[d.rule].name,
            'label', _rules[d.rule].label, 'priority', -d.neg_priority, 'base', _rules[d.rule].base, 'phrase', d.phrase))"""
    )
    out = out.withColumn("_kept", F.when(F.size("_placed") > 0, kept).otherwise(F.col("_placed"))).withColumn("detections", shown)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept_columns], "n_words", "detections")


def digest(scanned: DataFrame) -> DataFrame:
    """One row a document: counts and places of base phrases, labels, score (the chance that some evidence holds)."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    weights = F.array(*map(F.lit, WEIGHTS))
    score = F.aggregate("detections", F.lit(0.0), lambda acc, d: F.greatest(acc, F.element_at(weights, d["priority"])))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"), F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), score.alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")))
