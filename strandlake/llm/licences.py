"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, in two ways (by lines too, and by paragraphs, for wrapped texts); each is brought to a normal
form and looked up among known licence sentences. The sequence of their identifiers is matched against licence
rules in their order: the first, most specific rules take their sentences away from the later ones.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Sentences of public licence texts and notices, in normal form (lower case, runs of anything but letters and digits as one space).
SENTENCES = {
    "mit_release": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "mit license", "the mit license", "the mit license mit", "license mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is_mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "no_liability_mit": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2_notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0", "released under the apache license 2 0"],
    "apache2_compliance": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl_free_program": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_no_warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_see": ["see the gnu general public license for more details"],
    "gpl_received": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl_free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl_see": ["see the gnu lesser general public license for more details"],
    "agpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl_see": ["see the gnu affero general public license for more details"],
    "free_software": ["this program is free software", "this library is free software"],
    "gpl_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "agpl_terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "hope": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3_notice": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl3_notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3_notice": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "bsd 3 clause license"],
    "bsd2_notice": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "bsd 2 clause license"],
    "mpl2_notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "licensed under the mozilla public license 2 0"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc_by_nc_4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_sa_4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["licensed under cc0 1 0", "released under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "epl2_notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "licensed under the eclipse public license 2 0", "licensed under the eclipse public license version 2 0"],
    "zlib_as_is": ["this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl1_notice": ["distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0", "boost software license version 1 0"],
    "isc_notice": ["licensed under the isc license", "isc license"],
    "all_rights": ["all rights reserved"],
}
# Ordered rules: licence, sequence of sentence identifiers.
RULES = [
    ("MIT", ["mit_release", "mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"]),
    ("Apache-2.0", ["apache2_notice", "apache2_compliance", "apache2_copy", "apache2_as_is", "apache2_see"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-notice", ["gpl_free_program", "gpl_no_warranty", "gpl_see", "gpl_received"]),
    ("GPL-notice", ["gpl_free_program", "gpl_no_warranty", "gpl_see"]),
    ("LGPL-notice", ["lgpl_free", "gpl_no_warranty", "lgpl_see"]),
    ("AGPL-notice", ["agpl_free", "gpl_no_warranty", "agpl_see"]),
    ("GPL-notice", ["free_software", "gpl_terms", "hope", "implied", "gpl_see"]),
    ("LGPL-notice", ["free_software", "lgpl_terms", "hope", "implied", "lgpl_see"]),
    ("AGPL-notice", ["free_software", "agpl_terms", "hope", "implied", "agpl_see"]),
    ("zlib", ["zlib_as_is", "zlib_grant"]),
    ("MPL-2.0", ["mpl2_notice", "mpl2_copy"]),
    ("MIT", ["mit_release"]),
    ("MIT", ["mit_grant"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("GPL-notice", ["gpl_free_program"]),
    ("LGPL-notice", ["lgpl_free"]),
    ("AGPL-notice", ["agpl_free"]),
    ("GPL-notice", ["gpl_terms"]),
    ("LGPL-notice", ["lgpl_terms"]),
    ("AGPL-notice", ["agpl_terms"]),
    ("LGPL-3.0", ["lgpl3_notice"]),
    ("AGPL-3.0", ["agpl3_notice"]),
    ("BSD-3-Clause", ["bsd3_notice"]),
    ("BSD-2-Clause", ["bsd2_notice"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_notice"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("zlib", ["zlib_grant"]),
    ("BSL-1.0", ["bsl1_notice"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC0-1.0", ["cc0"]),
    ("All-rights-reserved", ["all_rights"]),
]
# Parts that vary between copies of a sentence: pattern on the normal form, and what stands for it.
VARIABLE = [
    ("^(neither the name of) .+ (nor the names of) (?:its|the|their) (contributors may be used) ", "the copyright holder"),
]
LINES = r"(?<=[.!?:;])\s+|[\r\n]+"
PARAGRAPHS = r"(?<=[.!?:;])\s+|\r?\n\s*\n\s*"


def gate_words(sentences: dict[str, list[str]]) -> list[str]:
    """Words of which every known sentence holds one, so that a text without any needs no cutting.

    Single words: whatever a text puts between the words of a sentence (line ends, spaces, marks) doesn't matter. The letter
    k is left out, since other characters than K become k in lower case. Words that meet most sentences come first.
    """
    left = {form: {w for w in form.split() if "k" not in w} for forms in sentences.values() for form in forms}
    able = lambda words: {w for w in words if len(w) >= 6} or {w for w in words if len(w) >= 4} or words
    left = {form: able(words) for form, words in left.items()}
    found = []
    while left:
        counts = Counter(w for words in left.values() for w in words)
        if not counts:
            return []
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        found.append(best)
        left = {form: words for form, words in left.items() if best not in words}
    return found


def _normal(s: Column, variable: list[tuple]) -> Column:
    s = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    for pattern, name in variable:
        s = F.regexp_replace(s, pattern, f"$1 {name} $2 its $3 ")
    return s


def _identified(text: Column, cut: str, sentences: dict[str, list[str]], variable: list[tuple]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for key, forms in sentences.items() for form in forms for x in (form, key)])
    longest = max(len(f) for forms in sentences.values() for f in forms)
    plain = F.filter(F.transform(F.split(text, cut, -1), lambda s: _normal(s, variable)), lambda s: (F.length(s) > 0) & (F.length(s) <= longest))
    return F.filter(F.transform(plain, lambda s: F.element_at(known, s)), lambda k: k.isNotNull())


def _matched(ids: Column, rules: list[tuple]) -> Column:
    """Licences of the rules that the sequence of identifiers meets, in the order of the rules; matched sentences are used up."""
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(",," + ",,".join(seq) + ",,").alias("sequence")) for name, seq in rules])
    start = F.struct(F.concat(F.lit(",,"), F.array_join(ids, ",,"), F.lit(",,")).alias("left"), F.expr("cast(array() as array<string>)").alias("found"))

    def step(s: Column, rule: Column) -> Column:
        hit = s["left"].contains(rule["sequence"])
        # a mark keeps what stood on either side apart
        left = F.when(hit, F.replace(s["left"], rule["sequence"], F.lit(",,#,,"))).otherwise(s["left"])
        return F.struct(left.alias("left"), F.when(hit, F.concat(s["found"], F.array(rule["name"]))).otherwise(s["found"]).alias("found"))

    return F.aggregate(listed, start, step, lambda s: F.array_distinct(s["found"]))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple] = RULES, variable: list[tuple] = VARIABLE) -> DataFrame:
    """Licences that each whole text names or holds.

    Returns the id, ``sentences`` (array of the identifiers met, cutting at lines too), and ``licences`` (array, in the order
    of the rules, those found by cutting at lines first). One row for each input row, repeated rows and null ids too; a
    null or empty text has none; an empty table gives an empty result; other columns are not read.
    """
    docs = common.pick(docs, id_col, text_col).toDF("id", "text")
    t, none = F.col("text"), F.expr("cast(array() as array<string>)")
    words = gate_words(sentences)
    gate = t.rlike("(?i)" + "|".join(words)) if words else F.lit(True)
    some = lambda cut: F.when(gate, _identified(t, cut, sentences, variable)).otherwise(none)
    cut = docs.select("id", some(LINES).alias("lines"), some(PARAGRAPHS).alias("paragraphs"))
    found = lambda ids: F.when(F.size(ids) > 0, _matched(F.col(ids), rules)).otherwise(none)
    return cut.select(F.col("id").alias(id_col), F.col("lines").alias("sentences"), F.array_distinct(F.concat(found("lines"), found("paragraphs"))).alias("licences"))
