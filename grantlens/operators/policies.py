"""Row rules of the style table, and the index of the menu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.privileges import mask_of
from grantlens.functions.sqltext import quote_ident, quote_literal
from grantlens.model import RELATION_KINDS
from grantlens.operators.diagnostics import effective_privileges
from grantlens.operators.roles import ADMIN_ROLE, FUNCTIONS, Reach, has_roles, role_oid_of, with_functions
from grantlens.scaling import attach, cut_lineage, number_rows

READERS_ROLE = "g_consult"
STRATEGIES = (0, 1, 2, 3, 4, 5, 99)


def style_row_permissions(
    requests: DataFrame, styles: DataFrame, registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach,
    strategies: tuple[int, ...] = STRATEGIES, admin: str = ADMIN_ROLE, readers: str = READERS_ROLE,
) -> DataFrame:
    """For each requested (user_oid, style_id) and strategy: may the user read and write the row?

    0: no row rules, the readers' role reads and the admin role writes. 1: the schema's producer
    writes. 2: and its editor, on rows of a role it has and that are no default. 3: 2 on default
    rows too. 4: 3 whoever owns the row. 5: 2, and the reader like the editor. 99: nothing is
    granted. From 1 on, members of both roles may use the table, everybody reads all rows, and the
    rules of a strategy add up; the admin role itself and superusers are above row rules.
    """
    rows = attach(
        requests.select("user_oid", "style_id"),
        styles.select("style_id", F.col("f_table_schema").alias("schema_name"), "owner", "use_as_default"),
        "style_id", "inner",
    )
    # styles name their schema without a database: a name stands for the registry row that has it
    named = registry.select("schema_name", "db_id", "producer", "editor", "reader")
    places = attach(rows, named.select("schema_name", "db_id").distinct(), "schema_name", "left")
    asked = with_functions(places, registry, roles)
    owners = roles.select(F.col("role_name").alias("owner"), F.col("role_oid").alias("_owner"))
    asked = attach(asked, owners, "owner", "left")
    asked = asked.withColumn("_admin_oid", role_oid_of(roles, admin)).withColumn("_readers_oid", role_oid_of(roles, readers))
    probes = {f"{f}_oid": f"is_{f}" for f in FUNCTIONS}
    probes |= {"_owner": "_has_owner", "_admin_oid": "_admin", "_readers_oid": "_readers"}
    flagged = has_roles(asked, closure, roles, "user_oid", probes)
    supers = roles.where("is_super").select(F.col("role_oid").alias("user_oid"), F.lit(True).alias("_super"))
    flagged = attach(flagged, supers, "user_oid")
    is_super = F.coalesce(F.col("_super"), F.lit(False))
    above = is_super | (F.col("user_oid") == role_oid_of(roles, admin))
    granted = F.col("_admin") | F.col("_readers")
    own_row, not_default = F.col("_has_owner"), ~F.col("use_as_default")

    def write(strategy: int) -> Column:
        if strategy == 0:
            return F.col("_admin")
        if strategy == 99:
            return is_super
        rule = F.col("is_producer")
        if strategy in (2, 5):
            rule = rule | (F.col("is_editor") & own_row & not_default)
        elif strategy == 3:
            rule = rule | (F.col("is_editor") & own_row)
        elif strategy == 4:
            rule = rule | F.col("is_editor")
        if strategy == 5:
            rule = rule | (F.col("is_reader") & own_row & not_default)
        return granted & (above | rule)

    options = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"),
                (is_super if s == 99 else granted).alias("can_select"),
                write(s).alias("can_insert"), write(s).alias("can_update"), write(s).alias("can_delete"),
            )
            for s in strategies
        ]
    )
    return flagged.select("user_oid", "style_id", F.inline(options))


def _readable_relations(
    user: str, all_objects: DataFrame, all_acl: DataFrame, roles: DataFrame, closure: DataFrame | Reach
) -> DataFrame:
    """Relations the user may SELECT from, in schemas it may use."""
    who = role_oid_of(roles, user).alias("user_oid")
    relations = all_objects.where(F.col("obj_kind").isin(*RELATION_KINDS))
    readable = effective_privileges(
        relations.select(who, "obj_oid"), all_objects, all_acl, roles, closure
    ).where(F.col("mask").bitwiseAND(F.lit(mask_of("r"))) != 0)
    schemas = all_objects.where(F.col("obj_kind") == "N")
    usable = effective_privileges(
        schemas.select(who, "obj_oid"), schemas, all_acl.where(F.col("obj_kind") == "N"), roles, closure,
        of_schemas=True,
    ).where(F.col("mask").bitwiseAND(F.lit(mask_of("U"))) != 0)
    inside = attach(
        relations.select("db_id", "schema_oid", "obj_oid", "obj_name"),
        usable.select(F.col("obj_oid").alias("schema_oid")), "schema_oid", "left_semi",
    )
    return inside.join(readable.select("obj_oid"), "obj_oid", "left_semi")


def menu_index(
    user: str,
    all_objects: DataFrame,
    all_acl: DataFrame,
    registry: DataFrame,
    namespaces: DataFrame,
    roles: DataFrame,
    closure: DataFrame | Reach,
    geometry_columns: DataFrame,
    connection: dict[str, str] | None = None,
) -> DataFrame:
    """Menu of the relations a user may read: three levels of rank, title path and data source.

    Ranks are per database: first levels among all created schemas, second levels and relations
    among what the user reads; missing levels come last, under the schema's or relation's name.
    A rank inside a group is a rank in the whole minus the lowest of the group, so no group is
    ever gathered in a task. ``connection``: service, host, port, user, sslmode, each optional.
    """
    created = registry.where("is_created").select("db_id", "schema_name", "level1", "level2")
    first = created.select(
        "db_id", F.col("level1").isNull().alias("_null1"), F.coalesce("level1", "schema_name").alias("_one")
    ).distinct()
    order1 = [F.col("db_id"), F.col("_null1"), F.col("_one")]
    first = _rank_in(number_rows(first, order1, "_n"), ["db_id"], "_n", "_ind1")

    real = namespaces.select("schema_oid", "schema_name")
    rows = attach(
        _readable_relations(user, all_objects, all_acl, roles, closure), real, "schema_oid", "inner"
    )
    rows = attach(rows, created, ["db_id", "schema_name"], "inner")
    rows = rows.withColumn("_null1", F.col("level1").isNull()).withColumn(
        "_one", F.coalesce("level1", "schema_name")
    ).withColumn("_null2", F.col("level2").isNull()).withColumn("_two", F.coalesce("level2", "obj_name"))
    rows = cut_lineage(rows)
    second_keys = ["db_id", "_null1", "_one", "_null2", "_two"]
    second = number_rows(rows.select(*second_keys).distinct(), [F.col(c) for c in second_keys], "_n")
    second = _rank_in(second, ["db_id", "_null1", "_one"], "_n", "_ind2")

    shapes = geometry_columns.select("obj_oid", "geom_column", "srid", "geom_type")
    rows = rows.join(shapes, "obj_oid", "left")
    order = [F.col(c) for c in (*second_keys, "obj_name", "obj_oid")] + [F.col("geom_column").asc_nulls_first()]
    rows = number_rows(rows, order, "_id")
    rows = _rank_in(rows, ["db_id"], "_id", "id", start=1)
    rows = _rank_in(rows, second_keys, "_id", "_ind3")
    rows = attach(rows, first, ["db_id", "_null1", "_one"], "inner")
    rows = rows.join(second, second_keys)

    text = F.lit
    has_shape = F.col("geom_column").isNotNull()
    database = F.concat(F.lit("db_"), F.col("db_id").cast("string"))

    def entry(rank: str, title: Column) -> Column:
        return F.concat(text("["), F.col(rank).cast("string"), text(', "'), title, text('"]'))

    def titled(name: str) -> Column:
        return F.replace(F.col(name), F.lit("&"), F.lit("et"))

    settings = connection or {}
    link = [text("dbname="), quote_literal(database), text(" ")]
    for key in ("service", "host", "port", "user", "sslmode"):
        if settings.get(key) is not None:
            value = quote_literal(text(settings[key])) if key in ("service", "user") else text(settings[key])
            link += [text(key + "=" if key == "service" else f" {key}="), value]
    uri = F.concat(
        text("vector:postgres:"), F.col("obj_name"), text(":"), *link,
        F.when(F.col("srid").isNotNull(), F.concat(text(" srid="), F.col("srid").cast("string"))).otherwise(text("")),
        F.when(F.col("geom_type").isNotNull(), F.concat(text(" type="), F.col("geom_type"))).otherwise(text("")),
        text(' table="'), F.col("schema_name"), text('"."'), F.col("obj_name"),
        F.when(has_shape, F.concat(text('" ('), quote_ident(F.col("geom_column")), text(") sql=::"))).otherwise(
            text('" sql=:::::NoGeometry')
        ),
    )
    return rows.select(
        "db_id", "id", "obj_oid",
        F.concat(
            F.col("obj_name"),
            F.when(has_shape & (F.col("geom_column") != "geom"), F.concat(text("."), F.col("geom_column"))).otherwise(text("")),
        ).alias("name"),
        F.concat(
            text('[[0, "'), F.upper(database), text('"], '), entry("_ind1", titled("_one")), text(", "),
            entry("_ind2", titled("_two")),
            F.when(~F.col("_null2"), F.concat(text(", "), entry("_ind3", F.col("obj_name")))).otherwise(text("")),
            text("]"),
        ).alias("model_index"),
        uri.alias("datasource_uri"),
    )


def _rank_in(numbered: DataFrame, group: list[str], number: str, into: str, start: int = 0) -> DataFrame:
    """Rank inside a group of contiguous rows, from their number in the whole."""
    lowest = numbered.groupBy(*group).agg(F.min(number).alias("_low"))
    ranked = attach(numbered, lowest, group, "inner")
    return ranked.withColumn(into, F.col(number) - F.col("_low") + F.lit(start)).drop(
        "_low", *([number] if number == "_n" else [])
    )
