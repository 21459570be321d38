"""Gaps between the rights that exist and the rights the registry calls for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.privileges import (
    code_mask,
    expand_privilege_codes,
    expected_mask,
    explode_mask,
    mask_of,
)
from grantlens.model import (
    DIAGNOSED_DEFAULT_ACL_TYPES,
    KINDS,
    PRIVILEGES,
    PUBLIC_OID,
    RELATION_KINDS,
    RIGHTS_KINDS,
)
from grantlens.operators.roles import Reach, as_reach, has_roles, with_class, with_reach
from grantlens.scaling import attach, cut_lineage, union_all
from grantlens.sources.stores import PIECE, schema_piece

REPORT = (
    "db_id", "schema_name", "obj_kind", "obj_oid", "column_name", "role_oid", "other_oid", "function",
    "privilege", "anomaly", "is_critical",
)


def effective_registry(registry: DataFrame, roles: DataFrame) -> DataFrame:
    """Created schemas with the roles that really exist behind their functions.

    public stays public (0); a role that was dropped leaves its function empty.
    """
    existing = roles.select("role_oid")

    def live(df: DataFrame, function: str) -> DataFrame:
        oid = f"{function}_oid"
        found = existing.select(F.col("role_oid").alias(oid), F.lit(True).alias("_found"))
        joined = attach(df, found, oid, "left")
        is_public = F.col(function) == "public" if function != "producer" else F.lit(False)
        return joined.withColumn(
            oid, F.when(is_public, F.lit(PUBLIC_OID)).when(F.col("_found"), F.col(oid)).cast("bigint")
        ).drop("_found")

    df = registry.where("is_created").select(
        "db_id", "schema_oid", "schema_name", "producer", "producer_oid", "editor", "editor_oid",
        "reader", "reader_oid",
    )
    for function in ("producer", "editor", "reader"):
        df = live(df, function)
    return df


def audited_objects(all_objects: DataFrame, registry: DataFrame, roles: DataFrame) -> DataFrame:
    """Objects of created schemas with the schema's functions.

    Objects belong to a schema by id; the schema itself is looked up by its registered name.
    """
    schemas = effective_registry(registry, roles).select(
        "db_id", "schema_oid", "schema_name", "producer_oid", "editor_oid", "reader_oid"
    )
    inside = attach(
        all_objects.where(F.col("obj_kind") != "N"), schemas.drop("db_id"), "schema_oid", "inner",
    )
    themselves = attach(
        all_objects.where(F.col("obj_kind") == "N").drop("schema_oid").withColumn(
            "schema_name", F.col("obj_name")
        ),
        schemas, ["db_id", "schema_name"], "inner",
    )
    return inside.unionByName(themselves)


def owner_anomalies(all_objects: DataFrame, registry: DataFrame, roles: DataFrame) -> DataFrame:
    """Objects and schemas whose owner is not the producer of the schema."""
    return audited_objects(all_objects, registry, roles).where(
        F.col("owner_oid") != F.col("producer_oid")
    ).select(
        "db_id", "schema_name", "obj_kind", "obj_oid",
        F.lit(None).cast("string").alias("column_name"),
        F.col("owner_oid").alias("role_oid"),
        F.col("producer_oid").alias("other_oid"),
        F.lit("owner").alias("function"),
        F.lit(None).cast("string").alias("privilege"),
        F.lit("owner").alias("anomaly"),
        F.lit(True).alias("is_critical"),
    )


def default_acl_anomalies(default_acl: DataFrame, registry: DataFrame) -> DataFrame:
    """Every default privilege of a created schema, on tables, sequences, routines and types."""
    schemas = registry.where("is_created").select("db_id", "schema_oid", "schema_name")
    entries = default_acl.where(F.col("obj_type").isin(*DIAGNOSED_DEFAULT_ACL_TYPES)).drop("db_id")
    named = attach(entries, schemas, "schema_oid", "inner")
    return expand_privilege_codes(named).select(
        "db_id", "schema_name",
        F.concat(F.lit("default "), F.col("obj_type")).alias("obj_kind"),
        F.lit(None).cast("bigint").alias("obj_oid"),
        F.lit(None).cast("string").alias("column_name"),
        F.col("grantee_oid").alias("role_oid"),
        F.col("grantor_oid").alias("other_oid"),
        F.lit(None).cast("string").alias("function"),
        "privilege",
        F.lit("default privilege").alias("anomaly"),
        F.lit(False).alias("is_critical"),
    )


_FUNCTIONS = ("owner", "reader", "editor", "fixed", "public")


def _expected(objects: DataFrame, fixed_grants: DataFrame | None) -> DataFrame:
    """One row per object and role that should hold something, one mask per function."""
    kind = F.col("obj_kind")

    def side(function: str, role: Column, mask: Column, test: Column) -> Column:
        masks = [
            (mask if f == function else F.lit(0)).alias(f"{f}_mask") for f in _FUNCTIONS
        ]
        return F.when(test & role.isNotNull() & (mask != 0), F.struct(role.alias("role_oid"), *masks))

    always = F.lit(True)
    sides = F.array(
        side("owner", F.col("owner_oid"), expected_mask(kind, "owner"), F.col("has_acl")),
        side("reader", F.col("reader_oid"), expected_mask(kind, "reader"), always),
        side("editor", F.col("editor_oid"), expected_mask(kind, "editor"), always),
        side("public", F.lit(PUBLIC_OID).cast("bigint"), expected_mask(kind, "public"), F.col("has_acl")),
    )
    keys = ["db_id", "schema_oid", "obj_kind", "obj_oid"]
    rows = objects.select(*keys, F.explode(sides).alias("_side")).where(F.col("_side").isNotNull())
    rows = rows.select(*keys, "_side.*")
    if fixed_grants is not None:
        fixed = attach(
            objects, fixed_grants, ["schema_name", "obj_name", "obj_kind"], "inner"
        ).select(
            *keys, "role_oid",
            *[
                (code_mask(F.col("codes")) if f == "fixed" else F.lit(0)).alias(f"{f}_mask")
                for f in _FUNCTIONS
            ],
        )
        rows = rows.unionByName(fixed)
    return rows.withColumn("column_name", F.lit(None).cast("string"))


def _packed(masks: list[Column]) -> Column:
    """Several masks side by side in one number, so that they are shuffled and merged as one."""
    width = len(PRIVILEGES)
    return reduce(Column.bitwiseOR, [F.shiftleft(m.cast("bigint"), i * width) for i, m in enumerate(masks)])


def _unpacked(packed: Column, at: int) -> Column:
    width = len(PRIVILEGES)
    return F.shiftright(packed, at * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _finding(mask: Column, anomaly: str, function: str | None = None) -> Column:
    return F.when(
        mask != 0,
        F.struct(
            mask.alias("mask"), F.lit(anomaly).alias("anomaly"),
            F.lit(function).cast("string").alias("function"),
        ),
    )


def privilege_anomalies(
    all_objects: DataFrame,
    all_acl: DataFrame,
    registry: DataFrame,
    roles: DataFrame,
    fixed_grants: DataFrame | None = None,
) -> DataFrame:
    """Missing, extra and transmissible privileges per object and role.

    Expected and effective rights are masks that meet in one aggregation by (object, role): a
    full outer join without the join, merged on the map side, so neither a hot schema nor a hot
    grantee gathers in one task. Pairs without a gap are dropped before the privileges are
    spelled out, and the registry filter runs on what remains of the extra rights.

    The owner and public are expected to hold rights only where the ACL is not NULL; 'owner' is
    the actual owner. Only a missing fixed right is critical.
    """
    objects = audited_objects(
        all_objects.where(F.col("obj_kind").isin(*RIGHTS_KINDS)), registry, roles
    )
    nothing = F.lit(0).cast("bigint")
    expected = _expected(objects, fixed_grants).select(
        "db_id", "schema_oid", "obj_kind", "obj_oid", "column_name", "role_oid",
        _packed([F.col(f"{f}_mask") for f in _FUNCTIONS]).alias("_expected"), nothing.alias("_held"),
    )
    codes = code_mask(F.col("codes"))
    effective = all_acl.select(
        "db_id", "schema_oid", "obj_kind", "obj_oid", "column_name",
        F.col("grantee_oid").alias("role_oid"), nothing.alias("_expected"),
        _packed(
            [F.when(F.col("grantable"), F.lit(0)).otherwise(codes), F.when(F.col("grantable"), codes).otherwise(F.lit(0))]
        ).alias("_held"),
    )
    pairs = (
        expected.unionByName(effective)
        .groupBy("db_id", "obj_kind", "obj_oid", "column_name", "role_oid")
        .agg(F.max("schema_oid").alias("schema_oid"), *[F.bit_or(m).alias(m) for m in ("_expected", "_held")])
    )
    masks = {f"{f}_mask": _unpacked(F.col("_expected"), i) for i, f in enumerate(_FUNCTIONS)}
    masks |= {"plain_mask": _unpacked(F.col("_held"), 0), "option_mask": _unpacked(F.col("_held"), 1)}
    pairs = pairs.withColumns(masks).drop("_expected", "_held")
    plain, option = F.col("plain_mask"), F.col("option_mask")
    held = plain.bitwiseOR(option)
    wanted = F.lit(0)
    for f in _FUNCTIONS:
        wanted = wanted.bitwiseOR(F.col(f"{f}_mask"))
    gaps = pairs.where((held != wanted) | (option != 0))
    unheld = F.bitwise_not(held)
    findings = F.array(
        *[_finding(F.col(f"{f}_mask").bitwiseAND(unheld), "missing", f) for f in _FUNCTIONS],
        _finding(plain.bitwiseAND(F.bitwise_not(wanted)), "extra"),
        _finding(option.bitwiseAND(F.bitwise_not(wanted)), "extra with grant option"),
        _finding(option.bitwiseAND(wanted), "grant option"),
    )
    rows = _registered(gaps, all_objects, registry).withColumn("_f", F.explode(findings))
    rows = rows.where(F.col("_f").isNotNull()).select(
        "db_id", "schema_name", "obj_kind", "obj_oid", "column_name", "role_oid", "_f.*"
    )
    return explode_mask(rows, "mask").select(
        "db_id", "schema_name", "obj_kind", "obj_oid", "column_name", "role_oid",
        F.lit(None).cast("bigint").alias("other_oid"),
        "function", "privilege", "anomaly",
        (F.coalesce(F.col("function"), F.lit("")) == "fixed").alias("is_critical"),
    )


def _registered(gaps: DataFrame, all_objects: DataFrame, registry: DataFrame) -> DataFrame:
    """Keep what belongs to created schemas, and name it: objects by id, schemas by name."""
    created = registry.where("is_created").select("db_id", "schema_oid", "schema_name")
    inside = created.select(F.lit(False).alias("_self"), F.col("schema_oid").alias("_id"), "schema_name")
    schemas = all_objects.where(F.col("obj_kind") == "N").select(
        "db_id", F.col("obj_name").alias("schema_name"), F.col("obj_oid").alias("_id")
    )
    themselves = attach(schemas, created.drop("schema_oid"), ["db_id", "schema_name"], "inner")
    scopes = inside.unionByName(themselves.select(F.lit(True).alias("_self"), "_id", "schema_name"))
    is_schema = F.col("obj_kind") == "N"
    placed = gaps.withColumn("_self", is_schema).withColumn(
        "_id", F.when(is_schema, F.col("obj_oid")).otherwise(F.col("schema_oid"))
    )
    return attach(placed, scopes, ["_self", "_id"], "inner")


def _views_and_sources(view_sources: DataFrame, all_objects: DataFrame, registry: DataFrame) -> DataFrame:
    views = all_objects.where(F.col("obj_kind").isin("v", "m")).select(
        F.col("obj_oid").alias("view_oid"), F.col("obj_kind").alias("view_kind"),
        F.col("schema_oid").alias("view_schema_oid"),
    )
    sources = all_objects.where(F.col("obj_kind").isin(*RELATION_KINDS, "S")).select(
        F.col("obj_oid").alias("source_oid"), F.col("obj_kind").alias("source_kind"),
        F.col("schema_oid").alias("source_schema_oid"), F.col("owner_oid").alias("source_owner_oid"),
        F.col("obj_name").alias("source_name"),
    )
    return view_sources.join(views, "view_oid").join(sources, "source_oid")


def view_source_anomalies(
    view_sources: DataFrame,
    all_objects: DataFrame,
    registry: DataFrame,
    roles: DataFrame,
    closure: DataFrame | Reach,
    own_schemas: tuple[str, ...] = (),
) -> DataFrame:
    """Views whose producer belongs to none of the functions of a source's schema."""
    live = effective_registry(registry, roles)
    of_view = live.where(~F.col("schema_name").isin(list(own_schemas))).select(
        "db_id", F.col("schema_oid").alias("view_schema_oid"), "schema_name", "producer_oid"
    )
    of_source = registry.where(F.col("schema_oid").isNotNull()).select(
        F.col("schema_oid").alias("source_schema_oid"),
        F.col("schema_name").alias("source_schema"),
        F.col("producer_oid").alias("source_producer"),
        F.col("editor_oid").alias("source_editor"),
        F.col("reader_oid").alias("source_reader"),
    )
    edges = _views_and_sources(view_sources, all_objects, registry)
    edges = attach(edges, of_view, "view_schema_oid", "inner")
    edges = attach(edges, of_source, "source_schema_oid", "inner")
    edges = edges.where(F.col("schema_name") != F.col("source_schema"))
    flags = {f"source_{f}": f"_is_{f}" for f in ("producer", "editor", "reader")}
    edges = has_roles(edges, closure, roles, "producer_oid", flags)
    outside = ~F.col("_is_producer") & F.col("source_producer").isNotNull()
    for function in ("editor", "reader"):
        outside = outside & (F.col(f"source_{function}").isNull() | ~F.col(f"_is_{function}"))
    return edges.where(outside).select(
        "db_id", "schema_name", F.col("view_kind").alias("obj_kind"), F.col("view_oid").alias("obj_oid"),
        F.lit(None).cast("string").alias("column_name"),
        F.col("producer_oid").alias("role_oid"),
        F.col("source_oid").alias("other_oid"),
        F.lit(None).cast("string").alias("function"),
        F.lit(None).cast("string").alias("privilege"),
        F.lit("view source").alias("anomaly"),
        F.lit(False).alias("is_critical"),
    ).distinct()


def effective_privileges(
    requests: DataFrame,
    all_objects: DataFrame,
    all_acl: DataFrame,
    roles: DataFrame,
    closure: DataFrame | Reach,
    of_schemas: bool = False,
) -> DataFrame:
    """Mask of the privileges of requested (role, object) pairs, through grants to the role, to
    roles it reaches, to public, and through ownership.

    A request asks whether two sets meet: the roles the user reaches and the grantees of the
    object. Each request walks the smaller of the two, so neither an object granted to a crowd
    nor a user who reaches half of the roles multiplies rows. Superusers hold everything the
    kind allows. With ``of_schemas`` the objects asked about are schemas.
    """
    in_scope = (F.col("obj_kind") == "N") if of_schemas else (F.col("obj_kind") != "N")
    kinds = expected_mask(F.col("obj_kind"), "owner")
    objects = all_objects.where(F.col("obj_kind").isin(*RIGHTS_KINDS) & in_scope).select(
        "obj_oid", "obj_kind", "owner_oid", "has_acl", kinds.alias("all_mask"),
        expected_mask(F.col("obj_kind"), "public").alias("public_default"),
    )
    asked = requests.select(F.col("user_oid"), "obj_oid").distinct().join(objects, "obj_oid")
    supers = roles.where("is_super").select(F.col("role_oid").alias("user_oid"), F.lit(True).alias("_super"))
    asked = attach(asked, supers, "user_oid")
    asked = with_class(asked, closure, "user_oid")
    reach = as_reach(closure)
    held = (
        all_acl.where(F.col("column_name").isNull() & in_scope)
        .groupBy("obj_oid", F.col("grantee_oid").alias("role_oid"))
        .agg(F.bit_or(code_mask(F.col("codes"))).alias("_held"))
    )
    # built-in defaults of the owner and of public apply where there is no ACL
    defaults = objects.where(~F.col("has_acl")).select(
        "obj_oid",
        F.explode(
            F.array(
                F.struct(F.col("owner_oid").alias("role_oid"), F.col("all_mask").alias("_held")),
                F.struct(F.lit(0).cast("bigint").alias("role_oid"), F.col("public_default").alias("_held")),
            )
        ).alias("_d"),
    ).select("obj_oid", "_d.*")
    grants = held.unionByName(defaults).where(F.col("_held") != 0)
    of_public = asked.join(
        grants.where(F.col("role_oid") == PUBLIC_OID).select("obj_oid", "_held"), "obj_oid"
    ).select("user_oid", "obj_oid", "_held")
    by_role = grants.where(F.col("role_oid") != PUBLIC_OID)
    grantees = by_role.groupBy("obj_oid").agg(F.count(F.lit(1)).alias("_grantees"))
    sizes = reach.classes.groupBy(F.col("class_id").alias("_class")).agg(F.count(F.lit(1)).alias("_reached"))
    routed = asked.select("user_oid", "obj_oid", "_class", "_self").join(grantees, "obj_oid")
    routed = attach(routed, sizes, "_class").withColumn("_reached", F.coalesce("_reached", F.lit(0)))
    by_object = F.col("_grantees") <= F.col("_reached")
    kept = ["user_oid", "obj_oid", "_class", "_self"]
    through = with_reach(routed.where(by_object).select(*kept).join(by_role, "obj_oid"), closure, "role_oid").where("_reach")
    lists = reach.classes.withColumnRenamed("class_id", "_class")
    listed = routed.where(~by_object).join(lists, "_class").join(by_role, ["obj_oid", "role_oid"])
    own = routed.where(~by_object & F.col("_self").isNotNull()).join(
        by_role.withColumnRenamed("role_oid", "_self"), ["obj_oid", "_self"]
    )
    through = union_all([found.select("user_oid", "obj_oid", "_held") for found in (through, listed, own)])
    as_super = asked.where(F.coalesce("_super", F.lit(False))).select(
        "user_oid", "obj_oid", F.col("all_mask").alias("_held")
    )
    total = of_public.unionByName(through).unionByName(as_super).groupBy("user_oid", "obj_oid").agg(
        F.bit_or("_held").alias("mask")
    )
    return total


def view_source_access(
    view_sources: DataFrame,
    all_objects: DataFrame,
    all_acl: DataFrame,
    registry: DataFrame,
    roles: DataFrame,
    closure: DataFrame | Reach,
) -> DataFrame:
    """Views whose producer cannot SELECT from a source, with the remedy.

    Remedy: make the producer reader of the source's schema when it has none, else grant it the
    reader role; none when the source's schema is not registered.
    """
    live = effective_registry(registry, roles)
    of_view = live.where(F.col("producer_oid").isNotNull()).select(
        "db_id", F.col("schema_oid").alias("view_schema_oid"), "schema_name", "producer_oid"
    )
    of_source = registry.where(F.col("schema_oid").isNotNull()).select(
        F.col("schema_oid").alias("source_schema_oid"), F.col("schema_name").alias("source_schema"),
        F.col("reader_oid").alias("source_reader"),
    )
    edges = _views_and_sources(view_sources, all_objects, registry)
    edges = attach(edges, of_view, "view_schema_oid", "inner")
    edges = attach(edges, of_source, "source_schema_oid", "left")
    readable = effective_privileges(
        edges.select(F.col("producer_oid").alias("user_oid"), F.col("source_oid").alias("obj_oid")),
        all_objects, all_acl, roles, closure,
    ).where(F.col("mask").bitwiseAND(F.lit(mask_of("r"))) != 0)
    readable = readable.select(
        F.col("user_oid").alias("producer_oid"), F.col("obj_oid").alias("source_oid")
    )
    denied = edges.join(readable, ["producer_oid", "source_oid"], "left_anti")
    return denied.select(
        "db_id", "schema_name", F.col("view_kind").alias("obj_kind"), F.col("view_oid").alias("obj_oid"),
        F.lit(None).cast("string").alias("column_name"),
        F.col("producer_oid").alias("role_oid"),
        F.col("source_oid").alias("other_oid"),
        F.when(F.col("source_schema").isNull(), F.lit(None))
        .when(F.col("source_reader").isNull(), F.lit("set reader"))
        .otherwise(F.lit("grant reader"))
        .alias("function"),
        F.lit("SELECT").alias("privilege"),
        F.lit("view source access").alias("anomaly"),
        F.lit(False).alias("is_critical"),
    ).distinct()


def target_scopes(targets: DataFrame, registry: DataFrame, all_objects: DataFrame) -> DataFrame:
    """Ids (db_id, schema_oid) under which objects and ACL entries of the target schemas are filed.

    A schema's objects carry the registered id; the schema itself is looked up by its name.
    """
    asked = targets.join(registry.where("is_created"), ["db_id", "schema_name"], "left_semi")
    registered = registry.join(asked, ["db_id", "schema_name"], "left_semi").select("db_id", "schema_oid")
    real = all_objects.where(F.col("obj_kind") == "N").select(
        "db_id", F.col("obj_name").alias("schema_name"), F.col("obj_oid").alias("schema_oid")
    )
    named = real.join(asked, ["db_id", "schema_name"], "left_semi").select("db_id", "schema_oid")
    return registered.unionByName(named).where(F.col("schema_oid").isNotNull()).distinct()


def within_targets(table: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of ``table`` filed under ``scopes``; one written by ``write_by_schema`` skips its other folders.

    The numbers of the folders are brought to the driver: there are never more than folders.
    """
    if PIECE in table.columns:
        wanted = scopes.select(schema_piece(F.col("db_id"), F.col("schema_oid"))).distinct().collect()
        table = table.where(F.col(PIECE).isin([r[0] for r in wanted]))
    return table.join(scopes, ["db_id", "schema_oid"], "left_semi")


def diagnose_rights(
    all_objects: DataFrame,
    all_acl: DataFrame,
    default_acl: DataFrame,
    view_sources: DataFrame,
    registry: DataFrame,
    roles: DataFrame,
    closure: DataFrame | Reach,
    fixed_grants: DataFrame | None = None,
    targets: DataFrame | None = None,
    view_access: bool = False,
    own_schemas: tuple[str, ...] = (),
) -> DataFrame:
    """The whole report, for all created schemas or for a table of targets (db_id, schema_name).

    A target that is not a created schema of the registry gives one FDD1 row. Targets without a
    ``db_id`` mean the schemas of that name in every database; unknown ones then have none either.
    Objects, ACL and default privileges are cut down to the targets before anything is compared.
    ``view_access`` adds the check that new views go through.
    """
    errors, wanted = None, None
    audited, objects, acl = registry, all_objects, all_acl
    if targets is not None:
        keys = [k for k in ("db_id", "schema_name") if k in targets.columns]
        asked = targets.select(*keys).dropna().distinct()
        known = registry.where("is_created").select("db_id", "schema_name")
        errors = asked.join(known, keys, "left_anti").select(
            (F.col("db_id") if "db_id" in keys else F.lit(None)).cast("bigint").alias("db_id"),
            "schema_name",
            *[F.lit(None).cast(t).alias(c) for c, t in zip(
                REPORT[2:9], ("string", "bigint", "string", "bigint", "bigint", "string", "string")
            )],
            F.lit("FDD1").alias("anomaly"), F.lit(True).alias("is_critical"),
        )
        wanted = known.join(asked, keys, "left_semi")
        audited = registry.join(wanted, ["db_id", "schema_name"], "left_semi")
        scopes = cut_lineage(target_scopes(wanted, registry, all_objects))
        objects, acl = within_targets(all_objects, scopes), within_targets(all_acl, scopes)
    parts = [
        owner_anomalies(objects, audited, roles),
        default_acl_anomalies(default_acl, audited),
    ]
    of_views = [view_source_anomalies(view_sources, all_objects, registry, roles, closure, own_schemas)]
    if view_access:
        of_views.append(
            view_source_access(view_sources, all_objects, all_acl, registry, roles, closure)
        )
    if targets is not None:
        of_views = [p.join(wanted, ["db_id", "schema_name"], "left_semi") for p in of_views]
        parts.append(errors)
    parts.append(privilege_anomalies(objects, acl, audited, roles, fixed_grants))
    # the checks of views are written first: in one plan the driver would hold what all checks broadcast
    parts += [cut_lineage(p.select(*REPORT)) for p in of_views]
    report = parts[0].select(*REPORT)
    for part in parts[1:]:
        report = report.unionByName(part.select(*REPORT))
    return report


def describe_anomalies(report: DataFrame, all_objects: DataFrame, roles: DataFrame) -> DataFrame:
    """Add a sentence to each row of the report."""
    label = None
    for k in KINDS:
        test = F.col("obj_kind") == k.code
        label = F.when(test, F.lit(k.label)) if label is None else label.when(test, F.lit(k.label))
    names = roles.select("role_oid", "role_name")
    named = attach(report, names, "role_oid", "left")
    other = names.select(F.col("role_oid").alias("other_oid"), F.col("role_name").alias("_other"))
    named = attach(named, other, "other_oid", "left")
    role = F.when(F.col("role_oid") == PUBLIC_OID, F.lit("public")).otherwise(F.col("role_name"))
    anomaly, privilege = F.col("anomaly"), F.col("privilege")
    text = (
        F.when(anomaly == "owner", F.format_string("owner %s is not producer %s", role, F.col("_other")))
        .when(
            anomaly == "default privilege",
            F.format_string("default privilege %s for %s granted by %s", privilege, role, F.col("_other")),
        )
        .when(anomaly == "missing", F.format_string("privilege %s missing for the %s (%s)", privilege, F.col("function"), role))
        .when(anomaly == "extra", F.format_string("privilege %s in excess for %s", privilege, role))
        .when(
            anomaly == "extra with grant option",
            F.format_string("privilege %s in excess for %s (with grant option)", privilege, role),
        )
        .when(anomaly == "grant option", F.format_string("%s may transmit privilege %s", role, privilege))
        .when(anomaly == "view source", F.format_string("producer %s belongs to no function of a source's schema", role))
        .when(anomaly == "view source access", F.format_string("producer %s cannot read a source", role))
        .when(anomaly == "FDD1", F.lit("schema is not registered as created"))
    )
    return named.withColumn("kind_label", label).withColumn("message", text).drop("role_name", "_other")
