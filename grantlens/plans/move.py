"""Plans that move objects from one schema to another, rights included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.privileges import expected_mask, privilege_list
from grantlens.functions.sqltext import alter_class, object_ref, quote_ident
from grantlens.model import RELATION_KINDS, SYSTEM_SCHEMA_PATTERN
from grantlens.operators.acl import all_privileges, object_names, render_commands
from grantlens.operators.diagnostics import effective_registry
from grantlens.operators.roles import Reach, acting_as
from grantlens.scaling import attach, cut_lineage, union_all

STEPS = {
    "set schema": 0,
    "owner": 1,
    "reset producer": 2,
    "revoke new editor": 3,
    "revoke old editor": 4,
    "copy to editor": 5,
    "standard editor": 6,
    "revoke new reader": 7,
    "revoke old reader": 8,
    "copy to reader": 9,
    "standard reader": 10,
    "revoke others": 11,
}


def _catalog(kind: Column) -> Column:
    """Objects of one catalog share their names inside a schema."""
    return (
        F.when(kind.isin(*RELATION_KINDS, "S", "i"), F.lit("class"))
        .when(kind == "X", F.lit("proc"))
        .when(kind.isin("T", "d"), F.lit("type"))
        .otherwise(kind)
    )


def move_conflicts(
    moves: DataFrame, all_objects: DataFrame, owned_sequences: DataFrame, table_indexes: DataFrame
) -> DataFrame:
    """Names already taken in the target schema.

    FDO8: the object's own (routines: same argument list, part of their name), FDO9/FDO10: an
    index with/without a constraint, FDO11: an owned sequence. ``table_indexes``: table_oid,
    schema_oid, index_name, is_constraint.
    """
    objects = all_objects.where(F.col("obj_kind") != "N")
    taken = objects.select(
        _catalog(F.col("obj_kind")).alias("catalog"), F.col("schema_oid").alias("target_schema_oid"),
        F.col("obj_name").alias("name"),
    ).unionByName(
        table_indexes.select(
            F.lit("class").alias("catalog"), F.col("schema_oid").alias("target_schema_oid"),
            F.col("index_name").alias("name"),
        )
    )
    moved = moves.select("obj_oid", "target_schema_oid").join(
        objects.select("obj_oid", "obj_kind", "obj_name"), "obj_oid"
    )
    own = moved.select(
        "obj_oid", "target_schema_oid", F.lit("FDO8").alias("error"),
        _catalog(F.col("obj_kind")).alias("catalog"), F.col("obj_name").alias("name"),
    )
    tables = moved.where(F.col("obj_kind").isin("r", "p")).select(
        F.col("obj_oid").alias("table_oid"), "target_schema_oid"
    )
    indexes = tables.join(table_indexes, "table_oid").select(
        F.col("table_oid").alias("obj_oid"), "target_schema_oid",
        F.when(F.col("is_constraint"), F.lit("FDO9")).otherwise(F.lit("FDO10")).alias("error"),
        F.lit("class").alias("catalog"), F.col("index_name").alias("name"),
    )
    sequences = objects.where(F.col("obj_kind") == "S").select(
        F.col("obj_oid").alias("sequence_oid"), F.col("obj_name").alias("name")
    )
    following = tables.join(owned_sequences, "table_oid").join(sequences, "sequence_oid").select(
        F.col("table_oid").alias("obj_oid"), "target_schema_oid", F.lit("FDO11").alias("error"),
        F.lit("class").alias("catalog"), "name",
    )
    asked = union_all([own, indexes, following])
    return asked.join(taken, ["catalog", "target_schema_oid", "name"], "left_semi").select(
        "obj_oid", "target_schema_oid", "error", "name"
    ).distinct()


def _placed_moves(moves, all_objects, registry, namespaces, roles) -> DataFrame:
    """Moves with the object, the functions of both schemas, and an error code."""
    things = all_objects.where(F.col("obj_kind") != "N").select(
        "db_id", "obj_oid", "obj_kind", "obj_name", "owner_oid"
    )
    held = moves.join(things, "obj_oid", "left")
    live = effective_registry(registry, roles)
    for side, new in (("source", ""), ("target", "new_")):
        functions = live.select(
            F.col("schema_oid").alias(f"{side}_schema_oid"),
            F.col("schema_name").alias(f"{side}_schema"),
            F.col("producer_oid").alias(f"{new}producer"),
            F.col("editor_oid").alias(f"{new}editor"),
            F.col("reader_oid").alias(f"{new}reader"),
        )
        held = attach(held, functions, f"{side}_schema_oid", "left")
    real = namespaces.select(
        F.col("schema_oid").alias("source_schema_oid"), F.col("schema_name").alias("_real")
    )
    held = attach(held, real, "source_schema_oid", "left")
    return held.withColumn(
        "error",
        F.when(F.col("_real").rlike(SYSTEM_SCHEMA_PATTERN), F.lit("FDO1"))
        .when(F.col("source_schema").isNull(), F.lit("FDO2"))
        .when(F.col("target_schema").isNull(), F.lit("FDO3"))
        .when(F.col("obj_kind").isNull(), F.lit("FDO5")),
    ).drop("_real")


def _act(test: Column, step: str, verb: Column, role: Column) -> Column:
    return F.when(
        test, F.struct(F.lit(STEPS[step]).alias("step"), verb.alias("verb"), role.alias("to_oid"))
    )


def _privilege_rules() -> Column:
    """What happens to each privilege row, by the role that holds it and the move's variant.

    Comparisons with a vacant function (NULL) are neither true nor false, so a rule applies only
    when it is stated for the vacant case.
    """
    role, verb, v = F.col("role_oid"), F.col("verb"), F.col("variant")
    p, e, l = F.col("producer"), F.col("editor"), F.col("reader")
    np_, ne, nl = F.col("new_producer"), F.col("new_editor"), F.col("new_reader")
    inverse = F.when(verb == "GRANT", F.lit("REVOKE")).otherwise(F.lit("GRANT"))
    transfers = v.isin(1, 3)
    kept = v != 4

    def none(c):
        return c.isNull()

    known = F.array(*[F.coalesce(c, F.lit(-1).cast("bigint")) for c in (p, e, l, np_, ne, nl)])
    return F.array(
        _act(v.isin(2, 6) & (role == p), "reset producer", inverse, np_),
        _act((role == ne) & (none(e) | (e != ne)) & (p != ne) & kept, "revoke new editor", inverse, ne),
        _act(
            (role == e) & (e != np_) & (none(ne) | (e != ne) | ~transfers) & kept,
            "revoke old editor", inverse, e,
        ),
        _act((role == e) & transfers & (e != ne), "copy to editor", verb, ne),
        _act(
            (role == nl) & (none(l) | (l != nl)) & (p != nl) & (none(e) | (e != nl)) & kept,
            "revoke new reader", inverse, nl,
        ),
        _act(
            (role == l) & (l != np_) & (none(ne) | (l != ne)) & (none(nl) | (l != nl) | ~transfers) & kept,
            "revoke old reader", inverse, l,
        ),
        _act((role == l) & transfers & (l != nl), "copy to reader", verb, nl),
        _act(v.isin(2, 3, 5) & ~F.array_contains(known, role), "revoke others", inverse, role),
    )


def _standard_rules() -> Column:
    """Standard grants on each moved unit for the functions of the target schema."""
    v = F.col("variant")

    def side(function: str, old: str, new: str):
        mask = expected_mask(F.col("obj_kind"), function)
        test = F.col(new).isNotNull() & (v.isin(2, 5, 6) | F.col(old).isNull()) & (v != 4) & (mask != 0)
        return F.when(
            test,
            F.struct(
                F.lit(STEPS[f"standard {function}"]).alias("step"),
                F.lit("GRANT").alias("verb"),
                F.col(new).alias("to_oid"),
                privilege_list(mask).alias("privilege"),
            ),
        )

    return F.array(side("editor", "editor", "new_editor"), side("reader", "reader", "new_reader"))


def move_object_plan(
    moves: DataFrame,
    all_objects: DataFrame,
    all_acl: DataFrame,
    registry: DataFrame,
    namespaces: DataFrame,
    roles: DataFrame,
    owned_sequences: DataFrame,
    conflicts: DataFrame | None = None,
    closure: DataFrame | Reach | None = None,
    actor: str | None = None,
) -> DataFrame:
    """Commands for each move (obj_oid, source_schema_oid, target_schema_oid, variant).

    Sequences owned by a moved table follow it. All rules look at a privilege row once: the rights
    of the moved units are joined to the moves by object, and a row fans out to the few actions
    its holder calls for. Moves that cannot take place are error rows: FDO1-3, FDO5, FDO8-11 for
    those listed in ``conflicts``, and with an ``actor`` FDO6 (target producer out of its reach)
    and FDO7 (owner out of its reach).
    """
    placed = _placed_moves(moves, all_objects, registry, namespaces, roles)
    if actor is not None:
        placed = acting_as(placed, "new_producer", "_produces", closure, roles, actor)
        placed = acting_as(placed, "owner_oid", "_owns", closure, roles, actor)
    if conflicts is not None:
        worst = conflicts.groupBy("obj_oid", "target_schema_oid").agg(F.min(
            F.struct(F.length("error").alias("n"), F.col("error").alias("e"))
        )["e"].alias("_conflict"))
        placed = placed.join(worst, ["obj_oid", "target_schema_oid"], "left").withColumn(
            "error", F.coalesce("error", "_conflict")
        ).drop("_conflict")
    if actor is not None:
        # a name conflict is found before the actor's rights are looked at
        denied = F.when(~F.col("_produces"), F.lit("FDO6")).when(~F.col("_owns"), F.lit("FDO7"))
        early = F.col("error").isNull() | F.col("error").isin("FDO9", "FDO10", "FDO11")
        placed = placed.withColumn(
            "error", F.when(early, F.coalesce(denied, F.col("error"))).otherwise(F.col("error"))
        ).drop("_produces", "_owns")
    placed = cut_lineage(placed)
    errors = placed.where(F.col("error").isNotNull())
    valid = placed.where(F.col("error").isNull()).drop("error")
    functions = ["variant", "target_schema_oid", "producer", "editor", "reader", "new_producer", "new_editor", "new_reader"]
    themselves = valid.select(
        "db_id", F.col("obj_oid").alias("moved_oid"), "obj_oid", "obj_kind", "owner_oid", *functions
    )
    sequences = all_objects.where(F.col("obj_kind") == "S").select(
        F.col("obj_oid").alias("sequence_oid"), F.col("owner_oid").alias("_owner")
    )
    following = (
        themselves.where(F.col("obj_kind").isin("r", "p"))
        .withColumnRenamed("obj_oid", "table_oid")
        .join(owned_sequences.select("table_oid", "sequence_oid"), "table_oid")
        .join(sequences, "sequence_oid")
        .select(
            "db_id", "moved_oid", F.col("sequence_oid").alias("obj_oid"), F.lit("S").alias("obj_kind"),
            F.col("_owner").alias("owner_oid"), *functions,
        )
    )
    # moved units are few next to the catalog and are read by every rule
    units = cut_lineage(themselves.unionByName(following))
    # rights of the units only, by object; column entries belong to their table
    keys = units.select("obj_oid").distinct()
    bound = moves.select("obj_oid").union(owned_sequences.select("sequence_oid"))
    acl = attach(all_acl.where(F.col("obj_kind") != "N"), keys, "obj_oid", "left_semi")
    objects = attach(
        all_objects.where(F.col("obj_kind") != "N"), keys, "obj_oid", "left_semi"
    )
    held = all_privileges(objects, acl, with_public=True).select("obj_oid", F.col("obj_kind").alias("held_kind"), "column_name", "role_oid", "verb", "privilege")
    moved = attach(held, units, "obj_oid", "inner")
    moved = moved.withColumn("_act", F.explode(_privilege_rules())).where(F.col("_act").isNotNull())
    by_privilege = moved.select(
        "db_id", "moved_oid", "obj_oid", F.col("held_kind").alias("obj_kind"), "column_name",
        F.col("target_schema_oid").alias("in_schema_oid"),
        "_act.step", "_act.verb", "privilege", F.col("_act.to_oid").alias("role_oid"),
    )
    standard = units.withColumn("_act", F.explode(_standard_rules())).where(F.col("_act").isNotNull())
    standard = standard.select(
        "db_id", "moved_oid", "obj_oid", "obj_kind", F.lit(None).cast("string").alias("column_name"),
        F.col("target_schema_oid").alias("in_schema_oid"),
        "_act.step", "_act.verb", "_act.privilege", F.col("_act.to_oid").alias("role_oid"),
    )
    owners = units.where(F.col("owner_oid") != F.col("new_producer")).select(
        "db_id", "moved_oid", "obj_oid", "obj_kind", F.lit(None).cast("string").alias("column_name"),
        F.col("target_schema_oid").alias("in_schema_oid"),
        F.lit(STEPS["owner"]).alias("step"), F.lit("OWNER").alias("verb"),
        F.lit(None).cast("string").alias("privilege"), F.col("new_producer").alias("role_oid"),
    )
    rendered = render_commands(
        union_all([by_privilege, standard, owners]), all_objects, namespaces, roles
    )
    names = object_names(all_objects, namespaces).where(F.col("obj_kind") != "N").select(
        "obj_oid", F.col("schema_ident").alias("_schema"), F.col("obj_ident").alias("_name")
    )
    target = namespaces.select(
        F.col("schema_oid").alias("target_schema_oid"), quote_ident(F.col("schema_name")).alias("_to")
    )
    relocated = attach(themselves.join(names, "obj_oid"), target, "target_schema_oid", "left")
    relocated = relocated.select(
        "moved_oid", "obj_oid", F.lit(STEPS["set schema"]).alias("step"), F.lit("SET SCHEMA").alias("verb"),
        F.lit(None).cast("string").alias("privilege"), F.lit(None).cast("bigint").alias("role_oid"),
        F.concat(
            F.lit("ALTER "), alter_class(F.col("obj_kind")), F.lit(" "),
            object_ref(F.col("obj_kind"), F.col("_schema"), F.col("_name")),
            F.lit(" SET SCHEMA "), F.col("_to"),
        ).alias("command"),
        F.lit(None).cast("string").alias("error"),
    )
    columns = ["moved_oid", "obj_oid", "step", "verb", "privilege", "role_oid", "command", "error"]
    failed = errors.select(
        F.col("obj_oid").alias("moved_oid"), "obj_oid", F.lit(-1).alias("step"),
        F.lit(None).cast("string").alias("verb"), F.lit(None).cast("string").alias("privilege"),
        F.lit(None).cast("bigint").alias("role_oid"), F.lit(None).cast("string").alias("command"), "error",
    )
    return union_all(
        [
            rendered.withColumn("error", F.lit(None).cast("string")).select(*columns),
            relocated.select(*columns),
            failed.select(*columns),
        ]
    )
