"""Licence scans by sentence rules: known licence sentences become identifiers, and ordered rules match their sequences.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences and their identifiers.
SENTENCES = {
    "Released under the MIT License": "MITref",
    "Licensed under the MIT License": "MITref",
    "This project is licensed under the terms of the MIT license": "MITref",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MITgrant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MITgrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MITnotice",
    "The software is provided as is, without warranty of any kind, express or implied": "MITwarranty",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITwarranty",
    "Licensed under the Apache License, Version 2.0": "Apache2ref",
    "Licensed under the Apache License, Version 2.0 (the License)": "Apache2ref",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "Apache2grant",
    "you may not use this file except in compliance with the License": "Apache2comply",
    "You may obtain a copy of the License at": "Apache2copy",
    "See the License for the specific language governing permissions and limitations under the License": "Apache2see",
    "This work is licensed under the GNU General Public License, version 3": "GPL3ref",
    "Licensed under the GNU General Public License v3.0": "GPL3ref",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPL3grant",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "GPLwarranty",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "GPLwarranty",
    "You should have received a copy of the GNU General Public License along with this program": "GPLcopy",
    "Licensed under CC BY-NC 4.0": "CCBYNC4ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CCBYNC4ref",
    "Licensed under CC BY 4.0": "CCBY4ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CCBY4ref",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDgrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "All rights reserved": "AllRights",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "This is free and unencumbered software released into the public domain": "UNLdomain",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UNLfree",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "MPL2form",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0": "MPL2copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0": "MPL2copy",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "GPL2grant",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "LGPL21grant",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "GPLwarranty",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "LGPL3grant",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "AGPL3grant",
    "Licensed under CC BY-SA 4.0": "CCBYSA4ref",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CCBYSA4ref",
    "Licensed under CC0 1.0": "CC0ref",
    "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0ref",
    "Licensed under the MIT License (see LICENSE)": "MITref",
    "Licensed under the MIT license, see LICENSE for details": "MITref",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation": "GPL2only",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License": "GPL2only",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation": "GPL3only",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License": "GPL3only",
    "Licensed under the GNU Lesser General Public License v3.0": "LGPL3ref",
    "This library is licensed under the GNU Lesser General Public License, version 3": "LGPL3ref",
    "Distributed under the Boost Software License, Version 1.0": "BSLref",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "BSLgrant",
    "This software is provided 'as-is', without any express or implied warranty": "Zlibwarranty",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "Zlibgrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDgrant",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "AdvertClause",
    "SPDX-License-Identifier: MIT": "MITref",
    "SPDX-License-Identifier: Apache-2.0": "Apache2ref",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL3ref",
    "SPDX-License-Identifier: BSD-3-Clause": "SPDXBSD3",
    "SPDX-License-Identifier: ISC": "ISCref",
    "SPDX-License-Identifier: MPL-2.0": "MPL2ref",
}
#: Known sentences with a hole, a holder's name of a few words, and the sentence above that each one counts as.
HOLED = [
    ("Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("Neither the name of {} nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("Neither the names of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
]
#: Words that a hole takes at most.
HOLE_WORDS = 12
#: A clause against endorsements in other words than the known ones; a licence without such a clause isn't told from it.
OTHER_ENDORSEMENT = ("OtherEndorsement", r"endorse\s+or\s+promote")
#: Licences that an SPDX line may name.
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MPL-2.0-no-copyleft-exception", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL",
    "Python-2.0", "UPL-1.0", "Unlicense", "Vim", "WTFPL", "X11", "Zlib", "ZPL-2.1",
]
#: An SPDX line's expression; and what stands between its licences.
SPDX_LINE, SPDX_BETWEEN = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+()\- ]*)", r"(?i)[ ()]+(?:and|or)[ ()]+"
#: Fixed values: (licence, identifiers in order, licences that a match of this rule needs to be absent). A licence that begins with
#: ~ is never told; others may give way to it.
RULES = [
    ("BSD-4-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "AdvertClause", "BSDendorse"], []),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"], ["BSD-4-Clause"]),
    ("~endorsement", ["OtherEndorsement"], []),
    ("~advertising", ["AdvertClause"], []),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"], ["BSD-3-Clause", "BSD-4-Clause", "~endorsement", "~advertising"]),
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty"], []),
    ("Apache-2.0", ["Apache2ref", "Apache2comply", "Apache2copy", "Apache2see"], []),
    ("Apache-2.0", ["Apache2grant"], []),
    ("GPL-3.0-or-later", ["GPL3grant", "GPLwarranty", "GPLcopy"], []),
    ("MIT", ["MITref"], []),
    ("Apache-2.0", ["Apache2ref"], []),
    ("GPL-3.0-only", ["GPL3ref"], ["GPL-3.0-or-later"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"], []),
    ("CC-BY-4.0", ["CCBY4ref"], []),
    ("ISC", ["ISCgrant", "ISCwarranty"], []),
    ("Unlicense", ["UNLdomain", "UNLfree"], []),
    ("MPL-2.0", ["MPL2form", "MPL2copy"], []),
    ("GPL-2.0-or-later", ["GPL2grant", "GPLwarranty"], []),
    ("LGPL-2.1-or-later", ["LGPL21grant", "GPLwarranty"], []),
    ("LGPL-3.0-or-later", ["LGPL3grant", "GPLwarranty"], []),
    ("AGPL-3.0-or-later", ["AGPL3grant", "GPLwarranty"], []),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"], []),
    ("CC0-1.0", ["CC0ref"], []),
    ("BSD-3-Clause", ["SPDXBSD3"], []),
    ("ISC", ["ISCref"], []),
    ("MPL-2.0", ["MPL2ref"], []),
    ("GPL-2.0-only", ["GPL2only", "GPLwarranty"], ["GPL-2.0-or-later"]),
    ("GPL-3.0-only", ["GPL3only", "GPLwarranty"], ["GPL-3.0-or-later"]),
    ("LGPL-3.0-only", ["LGPL3ref"], ["LGPL-3.0-or-later"]),
    ("BSL-1.0", ["BSLref"], []),
    ("BSL-1.0", ["BSLgrant"], []),
    ("Zlib", ["Zlibwarranty", "Zlibgrant"], []),
    ("0BSD", ["ZeroBSDgrant", "ISCwarranty"], []),
]
#: Where sentences end: a full stop, exclamation or question mark and white space. Blank lines end them too.
SENTENCE_END = r"(?<=[.!?])\s+"
#: Before the first word of a line: list marks such as a) or (2), and words that open comments.
LINE_MARK = r"(?m)^([^a-z0-9\n]*)(?:(?:[0-9]{1,2}|[a-z])\)|rem|dnl)[^\S\n]+"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def any_sentence(sentences: list[str]) -> str:
    """A pattern of all the normalised sentences, whose words may be parted by line breaks, the longest that fits first.
    Sentences with equal beginnings share them, so that a text is not compared with each one."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        more = [word + pattern(rest) for word, rest in node.items() if word]
        if not more:
            return ""
        longer = r"[ \n](?:" + "|".join(more) + ")" if len(more) > 1 else r"[ \n]" + more[0]
        return f"(?:{longer})?" if "" in node else longer

    return "(?:" + "|".join(word + pattern(rest) for word, rest in tree.items()) + ")"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Array of the identifiers of the known sentences of a text, in order.

    A known sentence begins and ends at a line's edge or a sentence's; in between it may be wrapped over lines, but holds no
    blank line. The longest one that begins somewhere counts, and none of those within it.
    """
    known = {normalised(k): v for k, v in sentences.items()}
    entries = [F.lit(x) for pair in known.items() for x in pair]
    any_of = any_sentence(list(known))
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LINE_MARK, "$1")
    # each sentence's end becomes a blank line, and lines keep only their words
    plain = F.regexp_replace(F.regexp_replace(plain, SENTENCE_END, "\n\n"), r"[^a-z0-9\n]+", " ")
    plain = F.trim(F.regexp_replace(plain, r" ?\n ?", "\n"))
    whole = {i: k for k, i in reversed(known.items())}
    hole = rf"[ \n]{{1,2}}[a-z0-9]+(?:[ \n]{{1,2}}[a-z0-9]+){{0,{HOLE_WORDS - 1}}}?[ \n]{{1,2}}"  # an abbreviation's full stop looks like a sentence's end
    for i in dict.fromkeys(i for _, i in HOLED) if sentences is SENTENCES else ():
        shapes = [hole.join(normalised(x).replace(" ", r"[ \n]") for x in sentence.split("{}")) for sentence, j in HOLED if j == i]
        plain = F.regexp_replace(plain, rf"(?<![^\n])(?:{'|'.join(shapes)})(?![^\n])", whole[i])
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^\n])({any_of})(?![^\n])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(F.create_map(*entries), F.translate(s, "\n", " ")))


def match_rules(ids: Column, rules=RULES) -> Column:
    """Licences, distinct and in the order of rules, of identifiers written like ',MITref,AllRights,'.

    A rule matches when its identifiers stand there in order, others in between allowed, and none of the licences that it
    gives way to matches.
    """
    hit = [ids.rlike("," + ",(?:.*,)?".join(map(re.escape, sequence)) + ",") for _, sequence, _ in rules]
    found = []
    for i, (licence, _, absent) in enumerate(rules):
        test = hit[i]
        for j, (other, _, _) in enumerate(rules):
            if other in absent:
                test = test & ~hit[j]
        found.append(F.when(test, F.lit(licence)))
    return F.array_distinct(F.array_compact(F.array(*[f for f, (licence, _, _) in zip(found, rules, strict=True) if not licence.startswith("~")])))


def spdx_licences(text: Column) -> Column:
    """The known licences that the SPDX lines of a text name, however they are joined; of one WITH an exception the licence."""
    named = F.create_map(*[F.lit(x) for name in SPDX for x in (name.lower(), name)])
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPDX_LINE), F.lit(1))
    one = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"(?i) with .*$", "")), r"^[ (]+|[ )]+$", "")
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, SPDX_BETWEEN), lambda y: F.element_at(named, one(y)))))
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), F.array_distinct(F.array_compact(parts))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, sentence_ids, licences, status, n_sentences of every row of docs (doc_id, text).

    sentence_ids are joined by commas. status is 'licensed' when a rule matches, 'unmatched' when there are known sentences
    but no rule matches, else 'none'. Licences that SPDX lines name follow those of rules. Null and empty texts have none; repeated
    rows stay; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", sentence_ids(F.col("text"), sentences).alias("found"))
    other, pattern = OTHER_ENDORSEMENT
    worded = (F.size("found") > 0) & F.lower(F.col("text")).rlike(pattern) & ~F.array_contains("found", "BSDendorse")
    rows = rows.withColumn("found", F.when(worded, F.concat("found", F.array(F.lit(other)))).otherwise(F.col("found")))
    rows = rows.withColumn("ids", F.array_join("found", ","))
    few = F.when(F.size("found") > 0, match_rules(F.concat(F.lit(","), F.col("ids"), F.lit(",")), rules)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("matched", F.array_distinct(F.concat(few, spdx_licences(F.col("text")))))
    status = F.when(F.size("matched") > 0, "licensed").when(F.size("found") > 0, "unmatched").otherwise("none")
    return rows.select("doc_id", F.col("ids").alias("sentence_ids"), F.array_join("matched", ",").alias("licences"), status.alias("status"), F.size("found").cast("long").alias("n_sentences"))


def op7_sentence_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """DuckDB SQL for texts whose sentences aren't wrapped over lines, as those of the test tables: all rules, by the order of identifiers."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = {normalised(k): v for k, v in SENTENCES.items()}
    spdx = ", ".join(f"({quote(x)})" for x in SPDX)
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    rules = ", ".join(f"({i}, {quote(x)}, {quote(','+',(?:.*,)?'.join(ids)+',')}, [{', '.join(map(quote, absent))}]::varchar[])" for i, (x, ids, absent) in enumerate(RULES))
    return f"""
with spdx(name) as (values {spdx}), known(sentence, id) as (values {values}), rules(n, licence, pattern, absent) as (values {rules}),
parts as (select doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) as s from documents),
found as (select doc_id, id, row_number() over () as place from (select doc_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as t from parts) x join known on t = sentence),
listed as (select doc_id, list(id order by place) as ids from found group by doc_id),
perdoc as (select l.doc_id, case when regexp_matches(lower(text), '{OTHER_ENDORSEMENT[1]}') and not list_contains(ids, 'BSDendorse') then list_append(ids, '{OTHER_ENDORSEMENT[0]}') else ids end as ids from listed l join documents d on d.doc_id = l.doc_id),
hits as (select doc_id, n, licence, absent from perdoc, rules where regexp_matches(',' || array_to_string(perdoc.ids, ',') || ',', rules.pattern)),
told as (select doc_id, 1000 + k as n, spdx.name as licence from (select doc_id, row_number() over () as k, trim(regexp_replace(unnest(regexp_split_to_array(line, '{SPDX_BETWEEN}')), '(?i) with .*$', ''), ' ()') as part
  from (select doc_id, unnest(regexp_extract_all(text, '{SPDX_LINE}', 1)) as line from documents)) x join spdx on lower(part) = lower(spdx.name)),
kept as (select * from told union all select doc_id, n, licence from hits h where not exists (select 1 from hits o where o.doc_id = h.doc_id and list_contains(h.absent, o.licence)) and not starts_with(licence, '~')),
per as (select doc_id, string_agg(licence, ',' order by n) as licences from (select doc_id, licence, min(n) as n from kept group by doc_id, licence) y group by doc_id)
select d.doc_id, coalesce(array_to_string(perdoc.ids, ','), '') as sentence_ids, coalesce(per.licences, '') as licences,
  case when per.licences is not null then 'licensed' when perdoc.ids is not null then 'unmatched' else 'none' end as status,
  cast(coalesce(len(perdoc.ids), 0) as bigint) as n_sentences
from documents d left join perdoc on d.doc_id = perdoc.doc_id left join per on d.doc_id = per.doc_id
"""


ORACLE = oracle_sql()
