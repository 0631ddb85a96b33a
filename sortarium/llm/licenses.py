"""License scans by ordered signature rules, on built-in functions alone.

A text is reduced to its words: A-Z lower-cased, words being runs of ASCII letters and digits and of
characters beyond ASCII, one blank between them. A rule is a regular expression over the words, a label, a priority and a
confidence. Some are written out: the wording of licenses and notices. The others are ways to grant or
name a license, each with the names of some fifty licenses; names that are common words elsewhere only
count where the way makes them a license's. A rule is only tried on texts that hold its keywords, and
none on texts without any keyword. Detections are intervals of the reduced text; going through them in order of
start, longest first, one is dropped if it lies within an earlier one of the same or a better
priority, which also settles equal intervals.

Beside these, phrases with a fixed label are counted word by word (the base).

Null texts count as empty: no words, no labels, score 0. Everything happens within the row, so
repeated rows give equal results, no row is lost, and extra columns pass through; added columns
replace those of the same name. The time for a text grows with its length and its own detections only.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that every form holds, short identifier in words, forms of the name in words.
NAMES = (
    ("mit", "mit", "mit", "mit license|mit licence|mit"),
    ("mit-0", "mit", "mit 0", "mit no attribution(?: license)?|mit 0"),
    ("x11", "x11", "x11", "x11 license|x11"),
    ("isc", "isc", "isc", "isc license|isc"),
    ("bsd-2", "bsd", "bsd 2 clause", "(?:simplified|freebsd|two clause|2 clause) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3", "bsd", "bsd 3 clause", "(?:new|revised|modified|three clause|3 clause) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4", "bsd", "bsd 4 clause", "(?:original|four clause|4 clause) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("0bsd", "bsd", "0bsd", "0bsd|zero clause bsd(?: license)?|bsd zero clause license"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("apache-1.1", "apache", "apache 1 1", "apache(?: software)? license(?: version)? 1 1|apache 1 1"),
    ("apache-2", "apache|asl", "apache 2 0", "apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?(?: license)?|asl 2 0"),
    ("gpl-2", "gnu|gpl", "gpl 2 0(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)2(?: 0)?(?: or later)?|(?:gnu )?gpl ?(?:v|version )?2(?: 0)?"),
    ("gpl-3", "gnu|gpl", "gpl 3 0(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?(?: or later)?|(?:gnu )?gpl ?(?:v|version )?3(?: 0)?"),
    ("lgpl-2.1", "lesser|lgpl", "lgpl 2 1(?: only| or later)?", "gnu lesser general public license (?:version |v)2 1|(?:gnu )?lgpl ?(?:v|version )?2 1"),
    ("lgpl-3", "lesser|lgpl", "lgpl 3 0(?: only| or later)?", "gnu lesser general public license (?:version |v)3(?: 0)?|(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?"),
    ("agpl-3", "affero|agpl", "agpl 3 0(?: only| or later)?", "gnu affero general public license (?:version |v)3(?: 0)?|(?:gnu )?agpl ?(?:v|version )?3(?: 0)?"),
    ("gfdl", "gnu|gfdl", "gfdl 1 [123]", "gnu free documentation license(?: version 1 [123])?|gfdl"),
    ("mpl-1.1", "mozilla|mpl", "mpl 1 1", "mozilla public license(?: version)? 1 1|mpl 1 1"),
    ("mpl-2", "mozilla|mpl", "mpl 2 0", "mozilla public license(?: version)? 2(?: 0)?|mpl 2(?: 0)?"),
    ("epl-1", "eclipse|epl", "epl 1 0", "eclipse public license(?: version)? 1(?: 0)?|epl 1(?: 0)?"),
    ("epl-2", "eclipse|epl", "epl 2 0", "eclipse public license(?: version)? 2(?: 0)?|epl 2(?: 0)?"),
    ("cddl", "cddl|common development", "cddl 1 [01]", "common development and distribution license(?: version 1 [01])?|cddl(?: 1 [01])?"),
    ("cc-by", "cc by|creative", "cc by [1234] [05]", "creative commons attribution(?: [1234] [05])?(?: international)?(?: license)?|cc by [1234] [05]"),
    ("cc-by-sa", "cc by|creative", "cc by sa [1234] [05]", "creative commons attribution share ?alike(?: [1234] [05])?(?: international)?(?: license)?|cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc by|creative", "cc by nd [1234] [05]", "creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international)?(?: license)?|cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc by|creative", "cc by nc [1234] [05]", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?(?: license)?|cc by nc(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by|creative", "cc by nc sa [1234] [05]", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international)?(?: license)?|cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by|creative", "cc by nc nd [1234] [05]", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international)?(?: license)?|cc by nc nd(?: [1234] [05])?"),
    ("cc0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("pddl", "pddl", "pddl 1 0", "pddl(?: 1 0)?"),
    ("odbl", "odbl|base license", "odbl 1 0", "open(?: data commons)? (?:data)?base license|odbl(?: 1 0)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? license|zlib"),
    ("boost", "boost|bsl", "bsl 1 0", "boost software license(?: version 1 0)?|bsl 1 0"),
    ("busl", "business|busl", "busl 1 1", "business source license(?: 1 1)?|busl 1 1"),
    ("artistic-2", "artistic", "artistic 2 0", "artistic license(?: version)? 2(?: 0)?"),
    ("python-2", "python|psf", "(?:python|psf) 2 0", "python software foundation license(?: version 2)?|psf license(?: version 2)?"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl", "openssl license"),
    ("php", "php", "php 3 01", "php license(?: version 3 0?1)?"),
    ("ruby", "ruby", "ruby", "ruby license"),
    ("ncsa", "ncsa", "ncsa", "university of illinois ncsa open source license|ncsa open source license"),
    ("wtfpl", "wtfpl|do what", "wtfpl", "wtfpl|do what the fuck you want to public license"),
    ("ofl", "ofl|open font", "ofl 1 1", "sil open font license(?: version)?(?: 1 1)?|ofl 1 1"),
    ("eupl", "eupl|european", "eupl 1 [12]", "european union public licen[cs]e(?: v?(?: ?1 [12]))?|eupl(?: v?1 [12])?"),
    ("ms-pl", "microsoft|ms pl", "ms pl", "microsoft public license|ms pl"),
    ("ms-rl", "microsoft|ms rl", "ms rl", "microsoft reciprocal license|ms rl"),
    ("sspl", "sspl|server side", "sspl 1 0", "server side public license(?: version 1)?|sspl(?: 1 0)?"),
    ("elastic-2", "elastic", "elastic 2 0", "elastic license(?: 2(?: 0)?)?"),
    ("upl", "upl|universal", "upl 1 0", "universal permissive license(?: v?1 0)?|upl 1 0"),
)

#: Kind, pattern around a name, priority (0 is best), confidence, which form, a keyword of its own.
WAYS = (
    ("identifier", "spdx license identifier {}", 0, 1.0, "id", "spdx"),
    ("grant", "(?:licensed|released|distributed|published|provided|available|redistributed)(?: to you)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the| a)? (?:{})", 1, 0.95, "name", "under"),
    ("subject", "subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the| a)? (?:{})", 1, 0.9, "name", "subject"),
    ("field", "(?:license|licence|licencia|licenza|lizenz)(?: is| type| name)? (?:the )?(?:{})", 1, 0.85, "name", "licen|lizenz"),
    ("see", "(?:see|read|accept|under)(?: the)?(?: full| text of)?(?: the)? (?:{})", 2, 0.7, "name", "see|read|accept|under"),
    ("dual", "dual licensed under(?: the)? (?:{})", 0, 0.95, "name", "dual"),
    ("name", "(?:{}) (?:licensed|licence|license|notice|terms)", 3, 0.6, "name", "licen|notice|terms"),
)

#: Names that are words of other languages or of trade; ways marked `careful` take these forms only.
CAREFUL = {"mit": "mit licen[cs]e", "x11": "x11 license", "isc": "isc license", "zlib": "zlib(?: libpng)? license"}
CAREFUL_WAYS = ("field", "see", "name")

#: Rule, label, keyword that every form holds, pattern, priority, confidence.
WORDING = (
    ("mit permission", "mit", "person obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0, 0.99),
    ("mit heading", "mit", "mit licen", "(?:the )?mit licen[cs]e", 3, 0.6),
    ("mit field", "mit", " mit", "(?:license|licence|licencia|licenza)(?: is| type| name)? (?:the )?mit(?= |$)(?! (?:der|dem|den|die|ein|einer|einem|eine|einschr|freundlich|allen|nur|und)(?: |$))", 1, 0.85),
    ("x11 heading", "x11", "x11 licen", "x11 licen[cs]e", 3, 0.6),
    ("isc heading", "isc", "isc licen", "isc licen[cs]e", 3, 0.6),
    ("zlib heading", "zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 3, 0.6),
    ("isc permission", "isc", "any purpose with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 0, 0.99),
    ("x11 advertising", "x11", "x consortium", "except as contained in this notice the names? of the x consortium shall not be used in advertising", 0, 0.99),
    ("bsd redistribution", "bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("bsd-3 endorsement", "bsd-3", "endorse or promote", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|other) (?:[^ ]+ ){0,4}may be used to endorse or promote products", 0, 0.97),
    ("bsd-4 advertising", "bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 0, 0.98),
    ("hpnd permission", "hpnd", "and its documentation for any purpose", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided", 0, 0.95),
    ("postgresql permission", "postgresql", "written agreement", "for any purpose without fee and without a written agreement is hereby granted", 0, 0.97),
    ("zlib liability", "zlib", "be held liable", "in no event will the authors? be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", 0, 0.98),
    ("gpl-2 notice", "gpl-2", "general public", "under the terms of the gnu general public license as published by the free software foundation either version 2", 0, 0.99),
    ("gpl-3 notice", "gpl-3", "general public", "under the terms of the gnu general public license as published by the free software foundation either version 3", 0, 0.99),
    ("lgpl-2.1 notice", "lgpl-2.1", "lesser general", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", 0, 0.99),
    ("lgpl-3 notice", "lgpl-3", "lesser general", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3", 0, 0.99),
    ("agpl-3 notice", "agpl-3", "affero general", "under the terms of the gnu affero general public license as published by the free software foundation either version 3", 0, 0.99),
    ("gpl-2 heading", "gpl-2", "june 1991", "gnu general public license version 2 june 1991", 0, 0.99),
    ("gpl-3 heading", "gpl-3", "june 2007", "gnu general public license version 3 29 june 2007", 0, 0.99),
    ("lgpl-2.1 heading", "lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999", 0, 0.99),
    ("lgpl-3 heading", "lgpl-3", "june 2007", "gnu lesser general public license version 3 29 june 2007", 0, 0.99),
    ("agpl-3 heading", "agpl-3", "november 2007", "gnu affero general public license version 3 19 november 2007", 0, 0.99),
    ("gpl network use", "agpl-3", "network server", "designed specifically to ensure cooperation with the community in the case of network server software", 1, 0.9),
    ("gfdl permission", "gfdl", "documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0, 0.99),
    ("apache-2 address", "apache-2", "apache org", "apache org licenses license 2 0", 0, 0.98),
    ("apache-2 heading", "apache-2", "january 2004", "apache license version 2 0 january 2004", 0, 0.99),
    ("apache-2 notice", "apache-2", "except in compliance", "you may not use this file except in compliance with the license", 2, 0.8),
    ("apache-1.1 acknowledgment", "apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 1, 0.85),
    ("mpl-2 notice", "mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 0, 0.99),
    ("mpl-1.1 notice", "mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1", 0, 0.99),
    ("epl notice", "epl-1", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 0, 0.99),
    ("epl-2 notice", "epl-2", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 0, 0.99),
    ("cddl notice", "cddl", "development and distribution", "the contents of this file are subject to the terms of the common development and distribution license", 0, 0.99),
    ("cc-by address", "cc-by", "creativecommons", "creativecommons org licenses by(?! (?:sa|nd|nc)(?: |$))", 0, 0.98),
    ("cc-by-sa address", "cc-by-sa", "creativecommons", "creativecommons org licenses by sa", 0, 0.98),
    ("cc-by-nd address", "cc-by-nd", "creativecommons", "creativecommons org licenses by nd", 0, 0.98),
    ("cc-by-nc address", "cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?! (?:sa|nd)(?: |$))", 0, 0.98),
    ("cc-by-nc-sa address", "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa", 0, 0.98),
    ("cc-by-nc-nd address", "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd", 0, 0.98),
    ("cc0 address", "cc0", "creativecommons", "creativecommons org publicdomain zero", 0, 0.98),
    ("cc0 waiver", "cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 0, 0.99),
    ("unlicense text", "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0, 0.99),
    ("public domain", "public-domain", "public domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", 2, 0.8),
    ("wtfpl terms", "wtfpl", "just do what", "you just do what the fuck you want to", 0, 0.99),
    ("boost permission", "boost", "software and accompanying documentation", "obtaining a copy of the software and accompanying documentation covered by this license", 0, 0.98),
    ("boost heading", "boost", "august 17th 2003", "boost software license version 1 0 august 17th 2003", 0, 0.99),
    ("ofl notice", "ofl", "font software", "this font software is licensed under the sil open font license", 0, 0.99),
    ("json clause", "json", "good not evil", "the software shall be used for good not evil", 0, 0.99),
    ("beerware", "beerware", "beer", "(?:you can buy me a beer in return|the beer ?ware license)", 1, 0.9),
    ("openssl acknowledgment", "openssl", "openssl project", "this product includes software developed by the openssl project", 1, 0.9),
    ("php notice", "php", "php license", "this source file is subject to version 3 0?1? ?of the php license", 0, 0.97),
    ("python agreement", "python-2", "psf license", "psf license agreement for python", 1, 0.9),
    ("all rights reserved", "all-rights-reserved", "rights reserved", "all rights reserved", 3, 0.5),
    # identifiers and names that stand alone
    ("bsd-2 identifier", "bsd-2", "bsd 2", "bsd 2 clause", 2, 0.8),
    ("bsd-3 identifier", "bsd-3", "bsd 3", "bsd 3 clause", 2, 0.8),
    ("bsd-4 identifier", "bsd-4", "bsd 4", "bsd 4 clause", 2, 0.8),
    ("apache-2 identifier", "apache-2", "apache 2 0", "apache 2 0", 2, 0.8),
    ("gpl-2 identifier", "gpl-2", "gpl", "(?:gplv2|gpl v2|gpl 2 0(?: only| or later)?)", 2, 0.8),
    ("gpl-3 identifier", "gpl-3", "gpl", "(?:gplv3|gpl v3|gpl 3 0(?: only| or later)?)", 2, 0.8),
    ("lgpl-2.1 identifier", "lgpl-2.1", "lgpl", "lgpl ?v?2 1(?: only| or later)?", 2, 0.8),
    ("lgpl-3 identifier", "lgpl-3", "lgpl", "(?:lgplv3|lgpl v3|lgpl 3 0(?: only| or later)?)", 2, 0.8),
    ("agpl-3 identifier", "agpl-3", "agpl", "(?:agplv3|agpl v3|agpl 3 0(?: only| or later)?)", 2, 0.8),
    ("mpl-2 identifier", "mpl-2", "mpl 2 0", "mpl 2 0", 2, 0.8),
    ("epl-2 identifier", "epl-2", "epl 2 0", "epl 2 0", 2, 0.8),
    ("cc-by identifier", "cc-by", "cc by", "cc by [1234] [05]", 2, 0.8),
    ("cc-by-sa identifier", "cc-by-sa", "cc by sa", "cc by sa", 2, 0.8),
    ("cc-by-nd identifier", "cc-by-nd", "cc by nd", "cc by nd", 2, 0.8),
    ("cc-by-nc-sa identifier", "cc-by-nc-sa", "cc by nc sa", "cc by nc sa", 2, 0.8),
    ("cc-by-nc-nd identifier", "cc-by-nc-nd", "cc by nc nd", "cc by nc nd", 2, 0.8),
    ("cc0 identifier", "cc0", "cc0 1 0", "cc0 1 0", 2, 0.8),
    ("gpl-2 name", "gpl-2", "gnu g", "gnu (?:general public license|gpl) ?v(?:ersion )?2", 2, 0.85),
    ("gpl-3 name", "gpl-3", "gnu g", "gnu (?:general public license|gpl) ?v(?:ersion )?3", 2, 0.85),
    ("lgpl-2.1 name", "lgpl-2.1", "gnu l", "gnu (?:lesser general public license|lgpl) ?v(?:ersion )?2 1", 2, 0.85),
    ("lgpl-3 name", "lgpl-3", "gnu l", "gnu (?:lesser general public license|lgpl) ?v(?:ersion )?3", 2, 0.85),
    ("agpl-3 name", "agpl-3", "gnu a", "gnu (?:affero general public license|agpl) ?v(?:ersion )?3", 2, 0.85),
    # lists of licenses, where each is named by its shortest form; those that span another's name don't suppress it
    ("mit in a choice", "mit", "either ", "either (?:of )?(?:the )?mit(?: licen[cs]e)? or", 1, 0.9),
    ("mit in a list", "mit", " mit ", "(?:the )?mit(?: licen[cs]e)? (?:and|or)(?: the)? (?:apache|gnu|gpl|[al]gpl|bsd|mozilla|mpl)", 2, 0.85),
    ("mit ends a list", "mit", " mit", "(?:apache(?: licen[cs]e)?(?: version)? 2(?: 0)?|bsd(?: [234] clause)?|gpl ?v?[23](?: 0)?|mpl 2 0) (?:and|or)(?: the)? mit", 3, 0.85),
    ("apache-2 in a list", "apache-2", " apache", "(?:mit|bsd(?: [234] clause)?|gpl ?v?[23](?: 0)?)(?: licen[cs]e)? (?:and|or)(?: the)? apache(?: licen[cs]e)?(?: version)? 2(?: 0)?", 3, 0.85),
)

#: Parts of words of which every written-out rule holds one.
WORDING_GATE = ("licen", "permi", "softwar", "public domain", "publicdomain", "rights reserved", "endorse", "beer", "x consortium", "written agreement", "just do what", "affirmer", "clause", "apache 2", "gpl", "mpl 2", "epl 2", "cc by", "cc0", "gnu ", "either", "mit and", "mit or", "or mit", "and mit", "apache")
#: Words without one of which no rule can match: the names' longer keywords, and what every way needs.
GATE = ("licen", "lizenz", " spdx ", " under ", " subject ", " notice ", " terms ", " accept ", " see ", " read ", " dual ")
NEEDS = "(?:^| )(?:licensed|licen[cs]e|licencia|licenza|lizenz|spdx|[al]?gpl(?:v?[23]|v|version)?|gnu|mit|bsd|apache|mozilla|mpl|cc|cc0|creative|gfdl|eclipse|epl|cddl|isc|x11|0bsd|asl|pddl|odbl|unlicense|zlib|bsl|busl|boost|business|artistic|psf|python|wtfpl|ofl|sil|eupl|ms|microsoft|sspl|upl|universal|european|open|ncsa|university|common|server|elastic|php|ruby|openssl|postgresql|do|zero|new|revised|modified|three|two|four|simplified|freebsd|original)(?: |$)"


def rules() -> list[tuple[str, str, str, str, str, int, float]]:
    """(rule, label, keywords of the name, keywords of the way, pattern, priority, confidence), in the order in which they are tried."""
    out = [(rule, label, keyword, keyword, f"(?<![^ ])(?:{pattern})(?![^ ])", priority, confidence) for rule, label, keyword, pattern, priority, confidence in WORDING]
    for kind, around, priority, confidence, form, own in WAYS:
        for label, keyword, short, name in NAMES:
            pattern = around.format(short if form == "id" else CAREFUL.get(label, name) if kind in CAREFUL_WAYS else name)
            out.append((f"{kind}:{label}", label, keyword, own, f"(?<![^ ])(?:{pattern})(?![^ ])", priority, confidence))
    return out


def words(text: str = "text") -> Column:
    """The words of a text, with two blanks between them and one at each end, so that every word has its own; else ''.

    lower() also lower-cases letters beyond ASCII; both forms are in words, no phrase or rule holds such
    a letter, and the two that lower to ASCII letters (U+0130, U+212A) are kept from it.
    """
    kept = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138"))
    inner = F.trim(F.regexp_replace(F.lower(kept), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _n_words(words: Column) -> Column:
    return F.floor((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))) / 2)


def base(docs: DataFrame, words: str) -> DataFrame:
    """docs and n_words, n_base, first_word, last_word, base_found (labels) from a column made by words()."""
    w = F.col(words)
    df = docs.withColumn("n_words", _n_words(w).cast("long"))
    count, first, last = [], [], []
    for phrase, _ in BASE:
        p = F.lit(" " + phrase.replace(" ", "  ") + " ")
        n = F.floor((F.octet_length(w) - F.octet_length(F.replace(w, p, F.lit("")))) / F.octet_length(p))
        held = F.contains(w, p)
        count.append(F.when(held, n).otherwise(F.lit(0)))
        first.append(F.when(held, _n_words(F.substring_index(w, " " + phrase.replace(" ", "  ") + " ", 1))))
        last.append(F.when(held, F.col("n_words") - _n_words(F.substring_index(w, " " + phrase.replace(" ", "  ") + " ", -1)) - len(phrase.split())))
    found = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(count, BASE)]))
    return df.withColumns({"n_base": reduce(Column.__add__, count).cast("long"), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "base_found": found})


def detections(docs: DataFrame, words: str) -> DataFrame:
    """docs and found: array<struct<start, stop, priority, rule, label, confidence>>, all matches, before suppression.

    start and stop are places in the words with one blank between them.
    """
    # The rules are one constant, made when the query is planned.
    named = [dict(zip(("rule", "label", "keyword", "own", "pattern", "priority", "confidence"), r)) for r in rules()]
    table = F.from_json(F.lit(json.dumps([r | {k: r[k].split("|") for k in ("keyword", "own")} for r in named])), "array<struct<rule: string, label: string, keyword: array<string>, own: array<string>, pattern: string, priority: int, confidence: double>>")
    text = F.replace(F.trim(F.col(words)), F.lit("  "), F.lit(" "))
    any_of = lambda parts: reduce(Column.__or__, [F.contains(words, F.lit(x.replace(" ", "  ") if x.strip() == x else x)) for x in parts])
    worded = any_of(WORDING_GATE) & any_of(sorted({r[2] for r in WORDING}))
    df = docs.withColumn("plain", F.when(worded | (any_of(GATE) & F.col(words).rlike(NEEDS)), text).otherwise(F.lit("")))
    keywords = sorted({k for r in rules() for part in r[2:4] for k in part.split("|")})
    df = df.withColumn("keywords", F.array(*map(F.lit, keywords)))
    # The keywords that a text holds are found once; transform() over an array of one is what binds them.
    matched = """
      element_at(transform(array(filter(keywords, k -> contains(plain, k))), present ->
      flatten(transform(filter(rules, r -> arrays_overlap(r.own, present) AND arrays_overlap(r.keyword, present) AND plain RLIKE r.pattern), r ->
        transform(
          aggregate(
            zip_with(regexp_extract_all(plain, r.pattern, 0), slice(split(plain, r.pattern, -1), 1, size(regexp_extract_all(plain, r.pattern, 0))), (h, g) -> named_struct('hit', h, 'gap', g)),
            named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, stop: int>>)),
            (acc, x) -> named_struct('at', acc.at + length(x.gap) + length(x.hit),
                                     'spans', array_append(acc.spans, named_struct('start', acc.at + length(x.gap), 'stop', acc.at + length(x.gap) + length(x.hit)))),
            acc -> acc.spans),
          s -> named_struct('start', s.start, 'order', -s.stop, 'priority', r.priority, 'rule', r.rule, 'label', r.label, 'confidence', r.confidence, 'stop', s.stop))))), 1)
    """
    none = "CAST(array() AS array<struct<start: int, order: int, priority: int, rule: string, label: string, confidence: double, stop: int>>)"
    return df.withColumn("rules", table).withColumn("found", F.expr(f"CASE WHEN plain = '' THEN {none} ELSE array_sort({matched}) END")).drop("rules", "plain", "keywords")


def kept(found: str = "found") -> Column:
    """The detections that aren't within an earlier one of the same or a better priority, from a sorted array."""
    reach = "transform(acc.reach, (e, i) -> IF(i >= x.priority, greatest(e, x.stop), e))"
    return F.expr(
        f"""aggregate({found}, named_struct('reach', array(-1, -1, -1, -1), 'out', CAST(array() AS array<struct<rule: string, label: string, start: int, stop: int, confidence: double>>)),
        (acc, x) -> IF(element_at(acc.reach, x.priority + 1) >= x.stop, acc, named_struct('reach', {reach},
          'out', array_append(acc.out, named_struct('rule', x.rule, 'label', x.label, 'start', x.start, 'stop', x.stop, 'confidence', x.confidence)))), acc -> acc.out)"""
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and n_words, n_base, first_word, last_word, base_labels, labels, licenses (the kept detections), score."""
    aside = {c: f"own {c}" for c in docs.columns if c.lower() in ("_words", "found", "base_found", "rules", "plain", "keywords")}
    docs = docs.withColumnsRenamed(aside)
    df = base(docs.withColumn("_words", words(aside.get(text, text))), "_words")
    df = detections(df, "_words").withColumn("licenses", kept())
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.col("licenses.confidence")), F.lit(0.0)))
    df = df.withColumns({"base_labels": join(F.col("base_found")), "labels": join(F.concat(F.col("base_found"), F.col("licenses.label"))), "score": score})
    return df.drop("_words", "found", "base_found").withColumnsRenamed({v: k for k, v in aside.items()})
