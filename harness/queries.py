"""Every operator as a query over the catalog tables of one test-data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.privileges import expand_privilege_codes, explode_mask
from grantlens.functions.sqltext import invert_command
from grantlens.operators import acl, diagnostics, maintenance, policies, registry, roles
from grantlens.plans import defaults, grants, move, ownership, reassign, reset
from grantlens.scaling import shared_folder, union_all
from grantlens.sources import catalog, ddl_log, snapshot, stores, taxonomy
from grantlens.streaming import events
from harness.catalogs import SECOND_SERVER, catalog_root, databases, mirror, server_root
from harness.inputs import Inputs

ADMIN_TARGET = "grp_0"
CONSULT = "g_consult"
DOMAINS = ["Brand#11*", "Brand#23*", "Brand#35*", "Brand#42*", "Brand#54*"]


class Catalog(Inputs):
    """Inputs plus the unified tables that most operators read."""

    @property
    def unified_objects(self) -> DataFrame:
        return catalog.unify_objects(self.objects, self.namespace_states)

    @property
    def unified_acl(self) -> DataFrame:
        return catalog.unify_acl(self.acl_items, self.schema_acl, self.column_acl)

    def _reach(self, mode: str) -> roles.Reach:
        found = []

        def part(name: str) -> DataFrame:
            if not found:
                found.append(roles.role_reach(self.roles, self.memberships, mode))
            return getattr(found[0], name)

        parts = ("members", "classes")
        return roles.Reach(*[self.land(f"{mode}_{name}", lambda name=name: part(name)) for name in parts])

    @property
    def usage(self) -> roles.Reach:
        return self._reach("usage")

    @property
    def member(self) -> roles.Reach:
        return self._reach("member")


QUERIES = {}


def query(fn):
    """Register ``fn(catalog)`` under its own name as a (spark, folder) query."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
    return fn


@query
def diagnose_rights(c):
    return diagnostics.diagnose_rights(
        c.unified_objects, c.unified_acl, c.default_acl, c.view_sources, c.registry, c.roles,
        c.usage, c.fixed_grants, view_access=True,
    )


@query
def diagnose_targets(c):
    """The report for a list of (database, schema), from tables filed by schema."""

    def filed(name: str, table: DataFrame) -> DataFrame:
        return c.land_with(f"{name}_by_schema", lambda path: stores.write_by_schema(table, path))

    return diagnostics.diagnose_rights(
        filed("objects", c.unified_objects), filed("acl", c.unified_acl), c.default_acl, c.view_sources, c.registry,
        c.roles, c.usage, c.fixed_grants, targets=c.diagnosis_targets, view_access=True,
    )


@query
def owner_anomalies(c):
    return diagnostics.owner_anomalies(c.unified_objects, c.registry, c.roles)


@query
def default_acl_anomalies(c):
    return diagnostics.default_acl_anomalies(c.default_acl, c.registry)


@query
def privilege_anomalies(c):
    return diagnostics.privilege_anomalies(
        c.unified_objects, c.unified_acl, c.registry, c.roles, c.fixed_grants
    )


@query
def view_source_anomalies(c):
    return diagnostics.view_source_anomalies(
        c.view_sources, c.unified_objects, c.registry, c.roles, c.usage
    )


@query
def view_source_access(c):
    return diagnostics.view_source_access(
        c.view_sources, c.unified_objects, c.unified_acl, c.registry, c.roles, c.usage
    )


@query
def effective_privileges(c):
    asked = c.object_requests
    held = diagnostics.effective_privileges(
        asked, c.unified_objects, c.unified_acl, c.roles, c.usage
    )
    return explode_mask(held, "mask")


@query
def explode_acl(c):
    """Entries of objects, schemas and columns, as texts; objects without an ACL give nothing."""
    codes = F.when(F.col("grantable"), F.regexp_replace("codes", "(.)", "$1*")).otherwise(F.col("codes"))
    grantee = F.when(F.col("grantee_oid") == 0, F.lit("")).otherwise(F.col("grantee_oid").cast("string"))
    grantor = F.coalesce("owner_oid", "grantee_oid").cast("string")
    item = F.concat(grantee, F.lit("="), codes, F.lit("/"), grantor)
    keys = ["obj_kind", "obj_oid", "column_name"]
    with_acl = c.unified_acl.select(*keys, F.array(item).alias("acl"))
    without = c.unified_objects.where("NOT has_acl").select(
        "obj_kind", "obj_oid", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("array<string>").alias("acl")
    )
    return acl.explode_acl(with_acl.unionByName(without))


@query
def expand_codes(c):
    keys = ["obj_kind", "obj_oid", "column_name", "grantee_oid"]
    return expand_privilege_codes(c.unified_acl.select(*keys, "codes", "grantable")).drop("codes")


QUERIES["expand_privilege_codes"] = QUERIES.pop("expand_codes")


@query
def role_privileges(c):
    return acl.role_privileges(c.unified_acl)


@query
def owner_missing_privileges(c):
    return acl.owner_missing_privileges(c.unified_objects, c.unified_acl)


@query
def public_privileges(c):
    return acl.public_privileges(c.unified_acl)


@query
def object_privileges(c):
    return acl.object_privileges(c.unified_objects, c.unified_acl, c.object_reset_requests)


@query
def object_public_privileges(c):
    return acl.object_public_privileges(c.unified_acl, c.object_reset_requests)


def _rendered(c, rows):
    return acl.render_commands(rows, c.unified_objects, c.namespaces, c.roles)


@query
def render_commands(c):
    rows = acl.all_privileges(c.unified_objects, c.unified_acl, spelled=False)
    return _rendered(c, rows).select("db_id", "obj_oid", "object_class", "role_oid", "command")


@query
def invert_commands(c):
    rows = _rendered(c, acl.all_privileges(c.unified_objects, c.unified_acl, spelled=False))
    lost = _rendered(c, acl.owner_missing_privileges(c.unified_objects, c.unified_acl, spelled=False))
    commands = rows.select("command").union(lost.select(F.lower("command"))).where("command IS NOT NULL")
    inverted = invert_command(F.col("command"))
    return commands.withColumn("inverted", inverted).withColumn(
        "error", F.when(F.col("inverted").isNull(), F.lit("FGR1"))
    )


@query
def resolve_relation_names(c):
    asked = c.object_requests.select("obj_oid").distinct()
    named = acl.resolve_relation_names(asked, c.unified_objects, c.namespaces)
    return named.select(
        "obj_oid", F.col("relation")[0].alias("schema_name"), F.col("relation")[1].alias("relation_name")
    )


@query
def role_closure(c):
    return union_all(
        [
            roles.role_closure(c.roles, c.memberships, mode).withColumn("mode", F.lit(mode))
            for mode in ("usage", "member")
        ]
    )


@query
def has_role_usage(c):
    return roles.has_role_usage(c.role_pairs, c.usage, c.roles)


@query
def schema_function_of_role(c):
    asked = c.access_requests
    return roles.schema_function_of_role(asked, c.registry, c.roles, c.usage)


@query
def relation_owner_members(c):
    asked = c.object_requests
    return roles.relation_owner_members(asked, c.unified_objects, c.roles, c.usage)


@query
def permission_label(c):
    asked = c.access_requests
    return roles.permission_label(asked, c.registry, c.roles, c.usage)


@query
def visible_registry(c):
    users = c.group_actors
    return roles.visible_registry(users, c.registry, c.roles, c.usage).select(
        "user_oid", "db_id", "schema_name", "schema_oid", "producer"
    )


@query
def registry_visibility(c):
    """What every role sees, in short."""
    found = roles.registry_visibility(c.roles.select("role_oid"), c.registry, c.roles, c.usage)
    return found.withColumn("schema_oid", F.col("schema_oid").cast("bigint"))


@query
def commit_registry(c):
    """The registry after two writers from one version: the second is refused and starts anew."""
    folder, key = _fresh_folder(c), ["db_id", "schema_name"]
    columns = [*key, "schema_oid", "is_created", "producer"]
    first = stores.commit(c.registry.select(*columns), folder, None)
    added = maintenance.register_unlisted_schemas(c.namespaces, c.registry, c.roles)
    added = added.select(*key, "schema_oid", F.lit(True).alias("is_created"), "producer")
    stores.commit(stores.upsert(stores.read_committed(c.spark, folder)[1], added, key), folder, first)
    asked = c.deregistrations.select(*key).distinct()

    def deregister(table):
        return table.join(asked, key, "left_anti")

    try:
        stores.commit(deregister(stores.read_committed(c.spark, folder, first)[1]), folder, first)
    except stores.Conflict:
        stores.commit_changes(c.spark, folder, deregister)
    return stores.read_committed(c.spark, folder)[1]


@query
def registry_listing(c):
    return roles.registry_listing(c.registry).withColumn("db_id", F.col("db_id").cast("bigint"))


@query
def manager_listing(c):
    return roles.manager_listing(c.registry).withColumn("db_id", F.col("db_id").cast("bigint"))


@query
def logins_missing_role(c):
    direct = roles.logins_missing_role(c.roles, c.memberships, CONSULT)
    indirect = roles.logins_missing_role(c.roles, c.memberships, CONSULT, False, c.member)
    return direct.withColumn("mode", F.lit("direct")).unionByName(indirect.withColumn("mode", F.lit("indirect")))


@query
def pick_grantor(c):
    users = c.roles.select("role_oid")
    return roles.pick_grantor(users, c.roles, c.memberships, c.member, ADMIN_TARGET)


@query
def role_databases(c):
    listed = roles.role_databases(c.role_dependencies)
    return listed.select("role_oid", F.array_join(F.col("databases").cast("array<string>"), ",").alias("databases"))


@query
def stale_roles(c):
    return roles.stale_roles(c.registry, c.roles, c.namespaces)


@query
def admin_membership_gaps(c):
    return roles.admin_membership_gaps(c.registry, c.roles, c.memberships, c.member)


@query
def invalid_producers(c):
    return roles.invalid_producers(c.registry, c.roles)


@query
def ownership_plan(c):
    plan = ownership.ownership_plan(c.unified_objects, c.registry, c.roles, c.namespaces, c.auto_types)
    return plan.select("db_id", "schema_name", "obj_kind", "obj_oid", "role_oid", "is_base", "command")


@query
def ownership_counts(c):
    objects = diagnostics.audited_objects(c.unified_objects, c.registry, c.roles)
    return ownership.ownership_counts(ownership.ownership_changes(objects, c.auto_types))


@query
def standard_grants(c):
    plan = grants.standard_grants(c.unified_objects, c.registry, c.roles, c.namespaces)
    return plan.select("db_id", "obj_kind", "obj_oid", "role_oid", "privilege", "function", "command")


@query
def schema_grants(c):
    live = diagnostics.effective_registry(c.registry, c.roles)
    return grants.schema_grants(live, c.roles).drop("schema_oid", "verb")


def _reset_inputs(c):
    return (
        c.unified_objects, c.unified_acl, c.default_acl, c.registry, c.namespaces, c.roles, c.usage
    )


@query
def reset_schema_plan(c):
    return reset.reset_schema_plan(
        c.reset_targets, *_reset_inputs(c), fixed_grants=c.fixed_grants, auto_types=c.auto_types,
        as_actor=True,
    )


@query
def reset_object_plan(c):
    return reset.reset_object_plan(
        c.object_reset_requests, c.unified_objects, c.unified_acl, c.registry, c.namespaces, c.roles,
        c.usage, roles.ADMIN_ROLE,
    )


def _conflicts(c):
    return move.move_conflicts(c.object_moves, c.unified_objects, c.owned_sequences, c.table_indexes)


@query
def move_conflicts(c):
    return _conflicts(c)


@query
def move_object_plan(c):
    return move.move_object_plan(
        c.object_moves, c.unified_objects, c.unified_acl, c.registry, c.namespaces, c.roles,
        c.owned_sequences, _conflicts(c), c.usage, roles.ADMIN_ROLE,
    )


@query
def reset_all_plan(c):
    return reset.reset_all_plan(
        *_reset_inputs(c), fixed_grants=c.fixed_grants, auto_types=c.auto_types
    )


@query
def reassign_role_plan(c):
    return reassign.reassign_role_plan(
        c.role_replacements, c.unified_objects, c.unified_acl, c.default_acl, c.outer_acl, c.registry,
        c.namespaces, c.roles, c.usage,
    )


@query
def reassigned_functions(c):
    return reassign.reassigned_functions(c.role_replacements, c.registry, c.roles)


@query
def default_acl_plan(c):
    plan = defaults.default_acl_plan(c.default_acl, c.namespaces, c.roles, c.usage, roles.ADMIN_ROLE)
    return plan.drop("target_oid")


@query
def outer_object_grants(c):
    return defaults.outer_object_grants(c.outer_acl, c.roles)


@query
def function_switch_plan(c):
    return grants.function_switch_plan(
        c.function_switches, c.unified_objects, c.unified_acl, c.namespaces, c.roles
    ).drop("schema_oid")


@query
def rename_owner_plan(c):
    return ownership.rename_owner_plan(
        c.registry, c.namespaces, c.roles, c.objects.select("schema_oid")
    )


@query
def reassign_owned_plan(c):
    plan = ownership.reassign_owned_plan(c.unified_objects, c.role_replacements, c.namespaces, c.roles)
    return plan.select("db_id", "obj_kind", "obj_oid", "role_oid", "old_owner_oid", "command")


def _edits(c):
    """The last edit of each row; those before it are superseded."""
    return registry.latest_changes(c.change_sets)[0]


def _normalised(c):
    return registry.normalise_changes(_edits(c), c.registry, c.roles, c.namespaces)


def _reviewed(c):
    return registry.review_changes(
        _edits(c), c.registry, c.roles, c.namespaces, c.database_creators, c.usage, c.member
    )


@query
def validate_changes(c):
    return registry.violations(_reviewed(c))


def _check(name: str, check: str):
    QUERIES[name] = lambda spark, sf_dir: registry.violations(_reviewed(Catalog(spark, sf_dir)), check)


_check("name_conflicts", "registry_duplicates")
for _name in ("role_repetition", "deletion_rules", "taxonomy_lock", "superuser_rules", "missing_name"):
    _check(_name, _name)


@query
def registry_duplicates(c):
    after = registry.align_block_and_name(_normalised(c)).where("op <> 'DELETE'")
    columns = ["db_id", "schema_name", "schema_oid"]
    return registry.registry_duplicates(c.registry.select(*columns).unionByName(after.select(*columns)))


@query
def block_name_violations(c):
    return registry.block_name_violations(_normalised(c)).select("change_id", "schema_name", "block")


@query
def normalise_changes(c):
    return _normalised(c).select(
        "change_id", "op", "schema_name", "block", "producer", "editor", "reader", "is_created",
        "in_nomenclature", "schema_oid", "producer_oid", "editor_oid", "reader_oid", "clean_producer",
        "clean_editor", "clean_reader",
    )


@query
def align_block_and_name(c):
    return registry.align_block_and_name(_normalised(c)).select(
        "change_id", "op", "schema_name", "block", "align_code"
    )


@query
def trash_transitions(c):
    return registry.trash_transitions(registry.align_block_and_name(_normalised(c)))


@query
def apply_registry_changes(c):
    return registry.apply_registry_changes(c.registry, _reviewed(c), c.namespaces)


@query
def register_unlisted_schemas(c):
    return maintenance.register_unlisted_schemas(c.namespaces, c.registry, c.roles)


@query
def deregister_schemas(c):
    remaining, answers = maintenance.deregister_schemas(c.registry, c.deregistrations)
    kept = remaining.select("db_id", "schema_name", F.lit("kept").alias("answer"))
    return answers.unionByName(kept)


@query
def import_taxonomy(c):
    taxonomy = c.nomenclature.withColumn("in_nomenclature", F.lit(True))
    return maintenance.import_taxonomy(c.registry, taxonomy).drop("in_nomenclature")


@query
def registry_from_events(c):
    return events.registry_from_events(c.ddl_events, c.preregistered)


def _fresh_folder(c) -> str:
    return f"{shared_folder(c.spark)}/{uuid.uuid4().hex}"


def _streamed_state(c) -> DataFrame:
    """State after streaming the whole event log, whose files are in no order, file by file."""
    folder = _fresh_folder(c)
    feed = ddl_log.read_ddl_events(c.spark, c.path_of("ddl_events"), streaming=True, files_per_trigger=1)
    events.start_registry_stream(feed, folder, f"{folder}/checkpoint", compact_every=3).awaitTermination()
    return events.read_registry_state(c.spark, folder)


@query
def registry_on_create(c):
    return events.registry_rows(_streamed_state(c), c.preregistered).where("is_created")


@query
def registry_on_alter(c):
    state = _streamed_state(c)
    altered = events.lives(state).where("is_live AND was_altered").select("schema_oid")
    return events.registry_rows(state, c.preregistered).join(altered, "schema_oid", "left_semi")


@query
def registry_on_drop(c):
    return events.registry_rows(_streamed_state(c), c.preregistered).where("NOT is_created")


def _streamed_rows(c, operator, work=None) -> DataFrame:
    """Output of an event operator, run as a stream into a Parquet folder."""
    folder = _fresh_folder(c)
    feed = ddl_log.read_ddl_events(c.spark, c.path_of("ddl_events"), streaming=True)
    events.start_object_stream(operator(feed), folder, f"{folder}/checkpoint", work=work).awaitTermination()
    return c.spark.read.parquet(f"{folder}/rows").drop("version")


@query
def view_warnings_on_create(c):
    """Events of the stream meet the snapshot, its ACLs and the closure batch by batch."""
    tables = (c.view_sources, c.unified_objects, c.unified_acl, c.registry, c.roles, c.usage)
    return _streamed_rows(c, lambda feed: feed, lambda batch: events.view_warnings_on_create(batch, *tables))


@query
def grants_on_create_object(c):
    registry_now, roles_now = c.registry, c.roles
    return _streamed_rows(c, lambda feed: events.grants_on_create_object(feed, registry_now, roles_now))


@query
def owner_on_alter_object(c):
    registry_now = c.registry
    return _streamed_rows(c, lambda feed: events.owner_on_alter_object(feed, registry_now))


@query
def style_row_permissions(c):
    return policies.style_row_permissions(
        c.style_requests, c.layer_styles, c.registry, c.roles, c.usage
    )


@query
def menu_index(c):
    return policies.menu_index(
        "grp_1", c.unified_objects, c.unified_acl, c.registry, c.namespaces, c.roles, c.usage,
        c.geometry_columns, {"host": "localhost", "port": "5432", "sslmode": "require"},
    )


@query
def read_taxonomy(c):
    return taxonomy.limit_domains(c.nomenclature, DOMAINS)


@query
def read_ddl_events(c):
    log = ddl_log.read_ddl_events(c.spark, c.path_of("ddl_events"))
    return log.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query
def write_plan(c):
    plan = defaults.default_acl_plan(c.default_acl, c.namespaces, c.roles, c.usage, roles.ADMIN_ROLE)
    columns = ["db_id", "schema_oid", "grantor_oid", "grantee_oid", "object_class", "privilege"]
    folder = _fresh_folder(c)
    stores.write_plan(plan.select(*columns, "command"), folder, columns)
    return c.spark.read.parquet(folder).select("seq", F.col("db_id").cast("bigint").alias("db_id"), *columns[1:], "command")


@query
def write_registry(c):
    """Rows that deregistration and registration leave, as the second version of the registry."""
    folder = _fresh_folder(c)
    stores.write_registry(c.registry, folder, 0)
    added = maintenance.register_unlisted_schemas(c.namespaces, c.registry, c.roles)
    current = stores.read_version(c.spark, folder, 0).select("db_id", "schema_name", "schema_oid", "is_created", "producer")
    changes = added.select("db_id", "schema_name", "schema_oid", F.lit(True).alias("is_created"), "producer")
    stores.write_registry(stores.upsert(current, changes, ["db_id", "schema_name"]), folder, 1)
    return stores.read_version(c.spark, folder, stores.latest_version(c.spark, folder))


def _pg(c, name: str) -> DataFrame:
    return c.spark.read.parquet(f"{catalog_root(c, name)}/{name}")


def _snapshot(c) -> snapshot.Snapshot:
    return snapshot.read_snapshot(c.spark, catalog_root(c), catalog.read_roles(_pg(c, "pg_roles")))


def _server_oids(df: DataFrame, *names: str) -> DataFrame:
    """Ids as each server has them, for comparison with tables that have no others."""
    return df.withColumns({n: F.col(n).bitwiseAND(F.lit((1 << 32) - 1)) for n in names})


@query
def read_catalog_snapshot(c):
    return _snapshot(c).objects


@query
def read_catalog_acl(c):
    return _snapshot(c).acl


@query
def read_default_acl(c):
    return _snapshot(c).default_acl


@query
def read_rejected_acl(c):
    """Entries whose roles are not given to the reader: all that name a producer."""
    known = catalog.read_roles(_pg(c, "pg_roles")).where("role_name not like 'prod%'")
    found = snapshot.read_snapshot(c.spark, catalog_root(c), known).rejected
    return found.groupBy("db_id", "obj_kind", "obj_oid", "column_name").agg(F.count(F.lit(1)).alias("items"))


@query
def snapshot_privilege_anomalies(c):
    """The privilege report on what the snapshot reader found."""
    found = _snapshot(c)
    registry_now = c.registry.withColumn("schema_oid", catalog.fleet_oid(F.col("db_id"), F.col("schema_oid")))
    report = diagnostics.privilege_anomalies(found.objects, found.acl, registry_now, c.roles, c.fixed_grants)
    return _server_oids(report, "obj_oid")


@query
def snapshot_role_privileges(c):
    return _server_oids(acl.role_privileges(_snapshot(c).acl), "obj_oid", "schema_oid")


@query
def read_roles(c):
    return catalog.read_roles(_pg(c, "pg_roles"))


@query
def read_memberships(c):
    return catalog.read_memberships(_pg(c, "pg_auth_members"))


@query
def read_view_sources(c):
    return catalog.read_view_sources(_pg(c, "pg_depend"), _pg(c, "pg_rewrite"))


@query
def read_owned_sequences(c):
    return catalog.read_owned_relations(_pg(c, "pg_depend"), _pg(c, "pg_class"), "S")


@query
def read_auto_types(c):
    return catalog.read_auto_types(_pg(c, "pg_depend"))


@query
def read_role_dependencies(c):
    return catalog.read_role_dependencies(_pg(c, "pg_shdepend"))


def _on_servers(c) -> tuple[DataFrame, snapshot.Snapshot]:
    """Roles and snapshot of a fleet of two servers that use the same ids for different roles."""
    root = server_root(c)
    known = catalog.read_roles(c.spark.read.parquet(f"{root}/pg_roles"))
    return known, snapshot.read_snapshot(c.spark, root, known, databases=databases(c))


def _one_space(c, df: DataFrame, *names: str) -> DataFrame:
    """Role ids of the two servers as those of the tables they were derived from."""
    shift = 1 << 32
    return df.withColumns({
        n: F.when(F.col(n) >= shift, mirror(c) - F.col(n).bitwiseAND(F.lit(shift - 1))).otherwise(F.col(n)) for n in names
    })


@query
def read_server_acl(c):
    """ACL entries of two servers, their role ids as the fleet has them."""
    return _on_servers(c)[1].acl


@query
def read_server_dependencies(c):
    found = c.spark.read.parquet(f"{server_root(c, 'pg_shdepend')}/pg_shdepend")
    return catalog.read_role_dependencies(found, databases(c))


@query
def server_role_closure(c):
    """Who reaches what on two servers: no path leads from one to the other."""
    root = server_root(c, "pg_roles", "pg_auth_members")
    known = catalog.read_roles(c.spark.read.parquet(f"{root}/pg_roles"))
    edges = catalog.read_memberships(c.spark.read.parquet(f"{root}/pg_auth_members"))
    return roles.role_closure(known, edges)


@query
def server_privilege_anomalies(c):
    """The privilege report over two servers, told with the ids of the one space of roles."""
    known, found = _on_servers(c)
    second, fleet = F.expr(SECOND_SERVER), mirror(c)

    def of_fleet(df: DataFrame, *names: str) -> DataFrame:
        there = lambda n: catalog.fleet_role(F.lit(1), F.when(F.col(n) == 0, 0).otherwise(fleet - F.col(n)))
        return df.withColumns({n: F.when(second, there(n)).otherwise(F.col(n)) for n in names})

    registry_now = c.registry.withColumn("schema_oid", catalog.fleet_oid(F.col("db_id"), F.col("schema_oid")))
    registry_now = of_fleet(registry_now, "producer_oid", "editor_oid", "reader_oid")
    # fixed rights go by schema and object; their names in one database are not those of another
    of_schema = c.registry.select("schema_name", "db_id").distinct()
    fixed = of_fleet(c.fixed_grants.join(of_schema, "schema_name"), "role_oid").drop("db_id")
    report = diagnostics.privilege_anomalies(found.objects, found.acl, registry_now, known, fixed)
    ids = [n for n in ("role_oid", "other_oid") if n in report.columns]
    return _one_space(c, _server_oids(report, "obj_oid"), *ids)
