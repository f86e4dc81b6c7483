"""Licence recognition by sentences, in DataFrame operations.

A text is cut into sentences, and each is normalised: lower case, letters, digits,
``+`` and inner dots only.  A table maps normalised sentences to identifiers; the
identifiers of a text, in order, are matched with the licence rules, each an
ordered list of identifiers that must follow one another.  Sentences with a name
in them are known by a pattern.  A sentence with licence words that is not known
parts those beside it, so that a rule never skips a clause.  A rule that lies
inside a longer matching rule of the text says nothing of its own and is left out.

All of it happens within the row; the tables are constants of bounded size.  Only
sentences with one of the triggers are looked up, and every sentence of the
table has one.  A null or empty text has no sentence and no licence.  Repeated
rows and ids are scanned one by one.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The long names of the Creative Commons licences, normalised, and what follows their version.
CREATIVE_COMMONS = {
    "by": ("attribution",),
    "by sa": ("attribution sharealike", "attribution share alike"),
    "by nc": ("attribution noncommercial", "attribution non commercial"),
    "by nd": ("attribution noderivatives", "attribution noderivs", "attribution no derivatives"),
    "by nc sa": ("attribution noncommercial sharealike", "attribution non commercial share alike"),
    "by nc nd": ("attribution noncommercial noderivatives", "attribution noncommercial noderivs"),
}
ENDS = {
    "2.0": ("generic", "generic license", "license"),
    "3.0": ("unported", "unported license", "license"),
    "4.0": ("international", "international license", "international public license", "license"),
}

# Names of licences in notices, normalised.
NAMES = {
    "MIT": ("mit license", "mit licence", "expat license"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl 2.0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl 3.0"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "lgplv2.1", "lgpl 2.1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgplv3", "lgpl 3.0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agplv3", "agpl 3.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0", "epl 2.0"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0", "boost license 1.0"),
    "Zlib": ("zlib license",),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1.0", "creative commons zero 1.0", "cc0 1.0 universal"),
} | {
    f"CC-{kind.upper().replace(' ', '-')}-{version}": (
        f"cc {kind} {version}",
        f"creative commons {kind} {version}",
        *(
            f"creative commons {words} {version} {end}"
            for words in long for end in ENDS[version]
        ),
    )
    for kind, long in CREATIVE_COMMONS.items()
    for version in ("2.0", "3.0", "4.0")
}
# Identifiers of licences as files name them.
SPDX = (
    *NAMES, "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-4-Clause",
)
NOTICES = (
    "licensed under {}", "licensed under the {}", "licensed under a {}", "released under {}", "released under the {}",
    "distributed under {}", "distributed under the {}", "distributed under the terms of the {}",
    "available under the {}", "published under the {}", "license {}",
)
SUBJECTS = (
    "", "this work is ", "this project is ", "this software is ", "this program is ", "this file is ",
    "this code is ", "this document is ", "this content is ",
)

# Sentences of licence texts, normalised.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-grant": "licensed under the apache license version 2.0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    # The GNU notices have a semicolon or a comma before the version and before "without even": cut there, or whole.
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "version-2-only": "version 2 of the license",
    "version-3-only": "version 3 of the license",
    "gpl2-only-grant": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-only-whole": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl3-only-whole": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "version-2": "either version 2 of the license or at your option any later version",
    "version-2.1": "either version 2.1 of the license or at your option any later version",
    "version-3": "either version 3 of the license or at your option any later version",
    "gpl2-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-no-warranty": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    # "v. 2.0" is cut, too
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-version": "2.0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v",
    "epl-version": "2.0 which is available at https www.eclipse.org legal epl 2.0",
    "epl-whole": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
}

#: Sentences with a place for a name: a pattern of the normalised sentence, and the sentence it stands for.
SLOTS = (
    (
        r"^neither the names? of (?:.*) n?or the names of (?:.*)contributors may be used to endorse or promote products"
        r" derived from this software without specific prior written permission$",
        SENTENCES["bsd-names"],
    ),
    (
        r"^this software is provided by (?:.*) as is and any express or implied warranties including but not limited to the"
        r" implied warranties of merchantability and fitness for a particular purpose are disclaimed$",
        SENTENCES["bsd-as-is"],
    ),
)

GNU_GRANTS = {
    "GPL-2.0-only": (("gpl-grant", "version-2-only"), ("gpl2-only-grant",), ("gpl2-only-whole",)),
    "GPL-3.0-only": (("gpl-grant", "version-3-only"), ("gpl3-only-whole",)),
    "LGPL-3.0-or-later": (("lgpl-grant", "version-3"), ("lgpl3-grant",)),
    "GPL-2.0-or-later": (("gpl-grant", "version-2"), ("gpl2-grant",)),
    "GPL-3.0-or-later": (("gpl-grant", "version-3"), ("gpl3-grant",)),
    "LGPL-2.1-or-later": (("lgpl-grant", "version-2.1"), ("lgpl21-grant",)),
    "AGPL-3.0-or-later": (("agpl-grant", "version-3"), ("agpl3-grant",)),
}
GNU_WARRANTIES = (
    ("gpl-no-warranty", "gpl-implied"), ("lgpl-no-warranty", "gpl-implied"), ("gpl-warranty",), ("lgpl-warranty",),
)

#: Each rule: a licence, and identifiers that follow one another.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    *[(name, (*grant, *rest)) for name, grants in GNU_GRANTS.items() for grant in grants for rest in GNU_WARRANTIES],
    ("MPL-2.0", ("mpl-terms", "mpl-version")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl-terms", "epl-version")),
    ("EPL-2.0", ("epl-whole",)),
    ("Unlicense", ("unlicense-domain",)),
    *[(name, (f"notice:{name}",)) for name in SPDX],
]

TRIGGER = (
    r"(?i)licen[sc]e|unencumbered|permission|copyright|copy of|distribut|released|published|available|warrant|provided"
    r"|advertising|in no event|2\.0"
)
#: What stands in the chain of identifiers for a sentence of licence words that is not known; links stand for nothing.
UNKNOWN, LINK = "?", r"^\W*(?:https?:|<https?:|www\.)"
#: A dot that ends no sentence.
SHORTENED = r"(?i)\b(inc|ltd|corp|co|llc)[.](,?[\x20\x09-\x0D]+(?-i:[a-z]))"
#: A file's tag is a sentence of its own.
TAG, TAGGED = r"(?i)SPDX-License-Identifier:[\x20\x09]*([A-Za-z0-9.+-]*[A-Za-z0-9+])", "spdx license identifier"


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence: the sentences above, and each notice of each name."""
    found = {text: name for name, text in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            for notice in NOTICES:
                for subject in SUBJECTS:
                    found.setdefault(subject + notice.format(name), f"notice:{licence}")
    for name in SPDX:
        found[f"{TAGGED} {re.sub('[^a-z0-9.+]+', ' ', name.lower())}"] = f"notice:{name}"
    missing = [s for s in found if not re.search(TRIGGER, s)]
    if missing:
        raise ValueError(f"no trigger word in {missing}")
    return found


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(text: Column) -> Column:
    """Sentences, which end at a blank line or at a mark before white space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SHORTENED, "$1$2")
    tagged = F.regexp_replace(plain, TAG, f"\u0001{TAGGED} $1\u0001")
    marked = F.regexp_replace(tagged, r"([.!?;:])[\x20\x09-\x0D]+", "$1\u0001")
    return F.split(marked, r"\x01|\n[\x20\x09-\x0D]*\n")


def normalised(sentence: Column) -> Column:
    plain = F.btrim(F.regexp_replace(_lower(sentence), r"[^a-z0-9.+]+", " "), F.lit(" ."))
    for pattern, stands_for in SLOTS:
        plain = F.regexp_replace(plain, pattern, stands_for)
    return plain


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``.

    doc_id, found: array of (sentence, identifier), sentence counted from 0;
    licences: sorted array of the licences whose rules match.
    """
    table = known_sentences()
    known = F.map_from_arrays(F.split(F.lit("\n".join(table)), "\n"), F.split(F.lit("\n".join(table.values())), "\n"))
    known_as = lambda x: F.try_element_at(known, normalised(x))

    def identifiers(sentence: Column) -> Column:
        """The sentence's, which may span lines, or else those of its lines."""
        lines = F.filter(F.split(sentence, "\n"), lambda x: x.rlike(TRIGGER))
        whole = known_as(sentence)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.transform(lines, known_as)))

    rows = documents.select("doc_id", sentences(F.col("text")).alias("_sentences"))
    numbered = F.transform("_sentences", lambda s, i: F.when(s.rlike(TRIGGER), F.struct(i.alias("i"), s.alias("s"))))
    rows = rows.select("doc_id", F.array_compact(numbered).alias("_candidates"))
    looked_up = F.transform(
        "_candidates",
        lambda x: F.transform(identifiers(x["s"]), lambda d: F.struct(x["i"].alias("sentence"), d.alias("identifier"))),
    )
    looked_up = rows.withColumn("_found", looked_up)
    rows = looked_up.select("doc_id", F.flatten("_found").alias("found"), "_found", "_candidates")
    # what is not known parts the sentences before and after it
    links = F.transform(
        F.arrays_zip("_found", "_candidates"),
        lambda x: F.when(F.size(x["_found"]) > 0, F.transform(x["_found"], lambda f: f["identifier"]))
        .when(x["_candidates"]["s"].rlike(LINK), F.array().cast("array<string>"))
        .otherwise(F.array(F.lit(UNKNOWN))),
    )
    chain = F.concat(F.lit(" "), F.array_join(F.flatten(links), " "), F.lit(" "))
    rows = rows.withColumn("_chain", F.when(F.size("found") > 0, chain))
    rules = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(f" {' '.join(ids)} ").alias("ids")) for n, ids in RULES])
    matching = F.filter(rules, lambda r: F.instr(F.col("_chain"), r["ids"]) > 0)
    rows = rows.withColumn("_rules", F.when(F.col("_chain").isNotNull(), matching))
    own = F.filter(
        "_rules",
        lambda r: ~F.exists("_rules", lambda o: (F.length(o["ids"]) > F.length(r["ids"])) & (F.instr(o["ids"], r["ids"]) > 0)),
    )
    licences = F.array_sort(F.array_distinct(F.transform(own, lambda r: r["licence"])))
    empty = F.array().cast("array<string>")
    return rows.select("doc_id", "found", F.coalesce(licences, empty).alias("licences"))


def scan_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_found, identifiers and licences, both joined by spaces."""
    return scan(documents).select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.array_join("found.identifier", " ").alias("identifiers"),
        F.array_join("licences", " ").alias("licences"),
    )
