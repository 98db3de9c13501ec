"""Licence scan by sentence rules, in Spark expressions only.

A text is cut into sentences, once along its lines and once with line breaks as spaces (wrapped texts). A sentence is normalised (lower case, runs of other
characters than letters and digits become one space) and looked up among known licence sentences. The identifiers found, in the order of
the text, are matched against ordered licence rules: a rule names identifiers in a row, and what an earlier rule has taken is gone
for later ones. Identifiers that no rule takes are reported as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

#: Known licence sentences, by identifier, in normalised form. Texts of public licences and usual notices, as the cut yields
#: them (a notice with ; or : inside a sentence gives several identifiers in a row), and uncut where other marks are usual as well.
SENTENCES: dict[str, tuple[str, ...]] = {
    "gpl3-line": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "apache2-line": ("licensed under the apache license version 2 0", "this work is licensed under the apache license version 2 0"),
    "mit-line": ("released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"),
    "ccbync4-line": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "ccby4-line": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "ccbysa4-line": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0-line": ("licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"),
    "mpl2-form": ("this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v"),
    "mpl2-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "gpl-redistribute-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "gpl-redistribute-2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    "gpl-redistribute": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "gpl-version-3": ("either version 3 of the license or at your option any later version",),
    "gpl-version-2": ("either version 2 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "gpl-warranty": ("without even the implied warranty of merchantability or fitness for a particular purpose", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    "gpl-details": ("see the gnu general public license for more details",),
    "gpl-received": ("you should have received a copy of the gnu general public license along with this program",),
    "apache2-grant": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license"),
    "apache2-comply": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache2-url": ("http www apache org licenses license 2 0", "https www apache org licenses license 2 0"),
    "apache2-copy-asis": ("you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    "apache2-asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache2-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "bsd-conditions": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-retain": ("1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd-binary": ("2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd-endorse": ("3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-asis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "rights-reserved": ("all rights reserved",),
}

#: Ordered licence rules: the first that fits takes its identifiers; longer ones stand before their parts.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-hope", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-version-3", "gpl-hope", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-hope", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-version-2", "gpl-hope", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-version-3")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-version-2")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-url", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-copy")),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-copy-asis",)),
    ("Apache-2.0", ("apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-comply", "apache2-url")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-asis")),
    ("MIT", ("mit-notice", "mit-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("BSD-3-Clause", ("bsd-retain", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-retain", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-binary", "bsd-asis")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-copy",)),
    ("GPL-3.0", ("gpl3-line",)),
    ("Apache-2.0", ("apache2-line",)),
    ("MIT", ("mit-line",)),
    ("CC-BY-NC-4.0", ("ccbync4-line",)),
    ("CC-BY-SA-4.0", ("ccbysa4-line",)),
    ("CC-BY-4.0", ("ccby4-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("all-rights-reserved", ("rights-reserved",)),
)

#: Every known sentence has one of these, so texts without any need no cutting.
KEYWORDS = "licen|permi|redistribut|warrant|copyright|mpl|cc0|rights"
assert all(any(k in s for k in KEYWORDS.split("|")) for group in SENTENCES.values() for s in group)


def _identifiers(text: Column, along_lines: bool) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    # a sentence ends with . ! ? ; or : before white space; along lines, also with the line
    marked = F.regexp_replace(text, r"([.!?;:])[ \t\r\n]+", "$1\u0001")
    marked = F.regexp_replace(marked, r"\n", "\u0001" if along_lines else " ")
    known = F.create_map(*[F.lit(x) for name, group in SENTENCES.items() for s in group for x in (s, name)])
    normal = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(F.transform(normal, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())


def _pattern(identifiers: tuple[str, ...]) -> str:
    """Identifiers in a row, as they stand in the text ``,a,,b,``."""
    return "," + ",,".join(identifiers) + ","


def _matched(identifiers: Column) -> Column:
    """Struct (rest, found): what no rule took, and the licences in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(ids)).alias("ids")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(","), F.concat_ws(",,", identifiers), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def take(acc: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(acc["rest"], rule["ids"], F.lit("|")).alias("rest"), F.array_append(acc["found"], rule["name"]).alias("found"))
        return F.when(F.contains(acc["rest"], rule["ids"]), taken).otherwise(acc)

    return F.aggregate(rules, start, take)


def scan(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with ``sentences`` (identifiers in the order of the text, of the cut that finds more of them; along lines if equal) and
    ``licences`` (distinct names, sorted), both arrays of strings.

    Null and empty texts give empty arrays. Texts of any length are scanned whole; repeated rows give repeated results. Columns of these names in the
    input are replaced. No shuffle and no Python.
    """
    text = F.col(text_column)
    may = F.coalesce(F.lower(text).rlike(KEYWORDS), F.lit(False))
    none = F.array().cast("array<string>")
    l, w = fresh(df, "l", "w")  # noqa: E741
    out = df.withColumns({l: F.when(may, _identifiers(text, True)).otherwise(none), w: F.when(may, _identifiers(text, False)).otherwise(none)})
    found = lambda c: F.when(F.size(c) > 0, _matched(F.col(c))["found"]).otherwise(none)
    out = out.withColumns({"sentences": F.when(F.size(w) > F.size(l), F.col(w)).otherwise(F.col(l)), "licences": F.array_sort(F.array_distinct(F.concat(found(l), found(w))))})
    return out.drop(l, w)


def op6_licence_scan(spark, sf_dir):
    """doc_id, n_sentences, sentences and licences (comma-separated) of every whole document."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.concat_ws(",", "sentences").alias("sentences"), F.concat_ws(",", "licences").alias("licences"))


def oracle_sql() -> str:
    """The same in DuckDB, rule by rule."""
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    pairs = [(s, name) for name, group in SENTENCES.items() for s in group]
    texts, names = quote(s for s, _ in pairs), quote(n for _, n in pairs)

    def identifiers(line: str) -> str:
        marked = f"regexp_replace(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n', {line}, 'g')"
        normal = f"list_transform(string_split({marked}, chr(1)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"
        return f"list_filter(list_transform({normal}, lambda s: ({names})[list_position({texts}, s)]), lambda x: x IS NOT NULL)"

    def rules(c: str) -> str:
        steps = [f"contains({c}{i}, '{_pattern(ids)}') AS f{c}{i}, replace({c}{i}, '{_pattern(ids)}', '|') AS {c}{i + 1}" for i, (_, ids) in enumerate(RULES)]
        return f"',' || array_to_string({c}, ',,') || ',' AS {c}0, " + ", ".join(steps)

    cases = ", ".join(f"CASE WHEN f{c}{i} THEN '{name}' END" for c in "lw" for i, (name, _) in enumerate(RULES))
    return f"""
        WITH cut AS (SELECT doc_id, coalesce({identifiers("chr(1)")}, []) AS l, coalesce({identifiers("' '")}, []) AS w FROM documents),
        steps AS (SELECT *, {rules("l")}, {rules("w")} FROM cut),
        most AS (SELECT *, CASE WHEN len(w) > len(l) THEN w ELSE l END AS s FROM steps)
        SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(array_to_string(s, ','), '') AS sentences,
            coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ','), '') AS licences
        FROM most"""
