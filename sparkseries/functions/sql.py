"""SQL texts for expressions over many columns: one text is planned far faster than
thousands of column objects."""

from __future__ import annotations


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts_sql(texts: list[str]) -> str:
    """A constant array of texts."""
    return "array(" + ", ".join(text_sql(t) for t in texts) + ")"


def columns_sql(names: list[str], kind: str) -> str:
    """An array of columns, all as one type; empty for no columns."""
    if not names:
        return f"cast(array() as array<{kind}>)"
    return "array(" + ", ".join(f"cast({name_sql(n)} as {kind})" for n in names) + ")"


def any_present_sql(names: list[str]) -> str:
    flags = ", ".join(f"if({name_sql(n)} is null, null, 1)" for n in names)
    return f"coalesce({flags}, null) is not null"


def present_cells_sql(names: list[str]) -> str:
    """Number of columns that are not null; added up in groups to keep the expression shallow."""
    terms = [f"cast({name_sql(n)} is not null as bigint)" for n in names]
    while len(terms) > 1:
        groups = [terms[i : i + 64] for i in range(0, len(terms), 64)]
        terms = ["(" + " + ".join(g) + ")" for g in groups]
    return terms[0]


def parse_sql(text: str, type_name: str) -> str:
    """SQL twin of :func:`sparkseries.functions.safe_parse`."""
    from .times import INTEGER
    from .values import DOUBLE_SHAPE

    if type_name == "string":
        return f"case when not ({text} = '' or lower({text}) = 'null') then {text} end"
    shape = INTEGER if type_name == "bigint" else DOUBLE_SHAPE
    return f"case when {text} rlike r'{shape}' then try_cast({text} as {type_name}) end"
