"""The normalised text (compatibility form, case folded, edges stripped) stated in SQL, code point by code point."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from evalweave.functions.text import EDGE_MARKS

_ALL = [*range(0x80, 0xD800), *range(0xE000, 0x20000)]


def _chr(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s) or "''"


def _values(pairs: dict[str, str]) -> str:
    return "values " + ", ".join(f"(chr({ord(k)}), {_chr(v)})" for k, v in pairs.items())


@lru_cache(maxsize=1)
def _maps() -> str:
    """(c, v) of code points whose compatibility form, or whose folded case, is another. Hangul composes, CJK stays."""
    wide = {chr(c): n for c in _ALL if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
    folded = {chr(c): n for c in _ALL if (n := chr(c).casefold()) != chr(c).lower()}
    return f"nf_wide(c, v) as ({_values(wide)}), nf_fold(c, v) as ({_values(folded)})"


def ctes(table: str) -> str:
    """CTEs down to ``{table}_norm(id, norm)`` of a table's texts."""
    t, marks = table, "".join(EDGE_MARKS).replace("'", "''")
    chars = lambda source, col: f"select id, unnest(regexp_extract_all({col}, '(?s).')) as c, generate_subscripts(regexp_extract_all({col}, '(?s).'), 1) as i from {source} where {col} <> ''"
    joined = lambda source, col, m: f"select x.id, string_agg(coalesce(m.v, x.c), '' order by x.i) as s from ({chars(source, col)}) x left join {m} m using (c) group by x.id"
    # lower case first leaves only what folds otherwise to the map
    return f""", {_maps()}, {t}_wide as ({joined(t, 'text', 'nf_wide')}), {t}_nfc as (select id, nfc_normalize(s) as s from {t}_wide), {t}_fold as ({joined(f'{t}_nfc', 's', 'nf_fold')}),
    {t}_norm as (select o.id, case when o.text is not null then trim(trim(regexp_replace(lower(coalesce(f.s, '')), '[\\s\x85\u00a0\x1c-\x1f\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+', ' ', 'g')), '{marks}') end as norm from {t} o left join {t}_fold f using (id))"""
