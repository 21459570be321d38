"""Rendering of identifiers and commands as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlens.functions.privileges import by_kind

# Key words that must be quoted when used as identifiers.
QUOTED_KEYWORDS = (
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit "
    "boolean both case cast char character check coalesce collate collation column concurrently "
    "constraint create cross current_catalog current_date current_role current_schema "
    "current_time current_timestamp current_user dec decimal default deferrable desc distinct do "
    "else end except exists extract false fetch float for foreign freeze from full grant greatest "
    "group grouping having ilike in initially inner inout int integer intersect interval into is "
    "isnull join lateral leading least left like limit localtime localtimestamp national natural "
    "nchar none normalize not notnull null nullif numeric offset on only or order out outer "
    "overlaps overlay placing position precision primary real references returning right row "
    "select session_user setof similar smallint some substring symmetric system_user table "
    "tablesample then time timestamp to trailing treat trim true union unique user using values "
    "varchar variadic verbose when where window with xmlattributes xmlconcat xmlelement xmlexists "
    "xmlforest xmlnamespaces xmlparse xmlpi xmlroot xmlserialize xmltable"
).split()


def quote_ident(name: Column) -> Column:
    """Identifier, quoted only if it has to be; NULL stays NULL."""
    plain = name.rlike(r"^[a-z_][a-z0-9_]*\z") & ~name.isin(QUOTED_KEYWORDS)
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain, name).otherwise(quoted)


def quote_literal(value: Column) -> Column:
    """String literal with doubled quotes (and the E form when it holds a backslash)."""
    body = F.replace(value, F.lit("'"), F.lit("''"))
    return F.when(
        F.contains(value, F.lit("\\")),
        F.concat(F.lit(" E'"), F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit("'")),
    ).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def role_ref(role_oid: Column, role_ident: Column) -> Column:
    """Role as written in a command: the pseudo-role public, or its quoted name."""
    return F.when(role_oid == 0, F.lit("public")).otherwise(role_ident)


def object_ref(kind: Column, schema_ident: Column, obj_ident: Column) -> Column:
    """Qualified name from quoted parts; a schema is its own name, a routine has its arguments.

    Names are quoted where they are stored, once per object, schema or role, and not once per
    command that mentions them.
    """
    qualified = F.concat(schema_ident, F.lit("."), obj_ident)
    return (
        F.when(kind == "N", schema_ident)
        .when(kind == "X", F.concat(qualified, F.lit("()")))
        .otherwise(qualified)
    )


def routine_word(server_version: int) -> str:
    return "FUNCTION" if server_version < 110000 else "ROUTINE"


def grant_class(kind: Column, server_version: int = 150000) -> Column:
    """TABLE, SEQUENCE, ROUTINE, TYPE or SCHEMA; NULL where rights are not managed."""
    routine = routine_word(server_version)
    return by_kind(kind, lambda k: routine if k.code == "X" else k.grant_class)


def alter_class(kind: Column, server_version: int = 150000) -> Column:
    """Word after ALTER for each kind of object."""
    routine = routine_word(server_version)
    return by_kind(kind, lambda k: routine if k.code == "X" else k.alter_class)


def grant_command(verb: Column, privilege: Column, klass: Column, target: Column, role: Column,
                  column_name: Column | None = None) -> Column:
    """GRANT … TO / REVOKE … FROM text; NULL when a part cannot be named."""
    what = privilege
    if column_name is not None:
        what = F.when(column_name.isNull(), privilege).otherwise(
            F.concat(privilege, F.lit(" ("), quote_ident(column_name), F.lit(")"))
        )
    link = F.when(verb == "GRANT", F.lit(" TO ")).otherwise(F.lit(" FROM "))
    return F.concat(verb, F.lit(" "), what, F.lit(" ON "), klass, F.lit(" "), target, link, role)


def owner_command(klass: Column, target: Column, role: Column) -> Column:
    return F.concat(F.lit("ALTER "), klass, F.lit(" "), target, F.lit(" OWNER TO "), role)


def invert_command(command: Column) -> Column:
    """GRANT … TO ⇄ REVOKE … FROM, first link word only; anything else is NULL (error FGR1).

    Patterns are slow, so only commands with white space other than blanks are searched with one.
    """
    odd = reduce(Column.__or__, [F.contains(command, F.lit(c)) for c in "\t\n\x0b\f\r"])

    def turned(verb: str, link: str, to_verb: str, to_link: str) -> Column:
        searched = F.regexp_replace(
            F.regexp_replace(command, rf"\A{verb}", to_verb), rf"(?s)\A(.*?)\s{link}\s", f"$1 {to_link} "
        )
        before = F.substring_index(command, f" {link} ", 1)
        body = F.substring(before, F.lit(len(verb) + 1), F.length(before))
        after = F.substring(command, F.length(before) + F.lit(len(link) + 3), F.length(command))
        linked = F.when(F.length(before) < F.length(command), F.lit(f" {to_link} ")).otherwise(F.lit(""))
        return F.when(odd, searched).otherwise(F.concat(F.lit(to_verb), body, linked, after))

    return F.when(F.startswith(command, F.lit("GRANT")), turned("GRANT", "TO", "REVOKE", "FROM")).when(
        F.startswith(command, F.lit("REVOKE")), turned("REVOKE", "FROM", "GRANT", "TO")
    )


def first_group(value: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without a match (an empty match stays empty)."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1))
