"""Reachability in the membership graph, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.sqltext import quote_ident
from grantlens.model import PUBLIC_OID, SUPERUSER_KEY
from grantlens.scaling import attach, cut_lineage, number_rows

ADMIN_ROLE = "g_admin"
FUNCTIONS = ("producer", "editor", "reader")


def role_oid_of(roles: DataFrame, name: str) -> Column:
    """Id of one named role as a scalar subquery; NULL when there is none."""
    return roles.where(F.col("role_name") == name).agg(F.max("role_oid")).scalar()


def _transitive(edges: DataFrame) -> DataFrame:
    """Transitive closure by doubling: depth d takes log2(d) rounds, cycles end by distinct.

    A longer path has a part that the last round found, so only its pairs are joined.
    """
    reach = fresh = cut_lineage(edges)
    while not fresh.isEmpty():
        known = reach
        onward = lambda df: df.select(F.col("member_oid").alias("role_oid"), F.col("role_oid").alias("_far"))
        longer = fresh.join(onward(known), "role_oid").unionByName(known.join(onward(fresh), "role_oid"))
        longer = longer.select("member_oid", F.col("_far").alias("role_oid")).distinct()
        fresh = cut_lineage(longer.join(known, ["member_oid", "role_oid"], "left_anti"))
        reach = known.unionByName(fresh)
    return reach


@dataclass(frozen=True)
class Reach:
    """A closure without its pairs: members that were granted the same roles share one list of what they reach.

    ``members`` (member_oid, class_id) has one row for each role, without a class where nothing was granted;
    ``classes`` (class_id, role_oid) lists what the members of a class reach. With ``itself`` every member also
    reaches itself, which is in no list. The operators take this or a table of pairs (member_oid, role_oid).
    """

    members: DataFrame
    classes: DataFrame
    itself: bool = True

    def pairs(self, members: DataFrame | None = None) -> DataFrame:
        """(member_oid, role_oid), each pair once; of all members or of those in the first column of ``members``."""
        of = self.members
        if members is not None:
            of = of.join(members.select(F.col(members.columns[0]).alias("member_oid")), "member_oid", "left_semi")
        # few rows become many: left alone, small partitions would be merged
        parts = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = of.repartition(parts, "class_id").join(self.classes, "class_id").select("member_oid", "role_oid")
        if not self.itself:
            return met
        own = of.select("member_oid", F.col("member_oid").alias("role_oid"))
        return met.where(F.col("role_oid") != F.col("member_oid")).unionByName(own)

    def reached_by(self, members: DataFrame) -> DataFrame:
        """(role_oid): what any of the members (member_oid) reaches; may repeat."""
        of = self.members.join(members, "member_oid", "left_semi")
        found = self.classes.join(of.select("class_id").distinct(), "class_id", "left_semi").select("role_oid")
        return found.union(of.select("member_oid")) if self.itself else found

    def holders(self, wanted: DataFrame) -> DataFrame:
        """(member_oid, role_oid): who reaches each of the few roles in ``wanted`` (role_oid); may repeat."""
        lists = self.classes.join(wanted, "role_oid", "left_semi")
        found = self.members.join(lists, "class_id").select("member_oid", "role_oid")
        if not self.itself:
            return found
        own = self.members.select("member_oid", F.col("member_oid").alias("role_oid"))
        return found.unionByName(own.join(wanted, "role_oid", "left_semi").select("member_oid", "role_oid"))

    def selves(self) -> DataFrame:
        """(member_oid): who reaches itself."""
        if self.itself:
            return self.members.select("member_oid")
        return self.classes.where(F.col("class_id") == F.col("role_oid")).select(F.col("class_id").alias("member_oid"))

    def least(self, values: DataFrame) -> DataFrame:
        """(member_oid, _least): for each member the least ``_value`` (role_oid, _value) of the roles it reaches."""
        lists = self.classes.join(values, "role_oid").groupBy("class_id").agg(F.min("_value").alias("_value"))
        found = self.members.join(lists, "class_id").select("member_oid", "_value")
        if self.itself:
            own = values.select(F.col("role_oid").alias("member_oid"), "_value")
            found = found.unionByName(self.members.select("member_oid").join(own, "member_oid"))
        return found.groupBy("member_oid").agg(F.min("_value").alias("_least"))


def as_reach(closure: DataFrame | Reach) -> Reach:
    """A table of pairs as a :class:`Reach` in which everybody is a class."""
    if isinstance(closure, Reach):
        return closure
    members = closure.select("member_oid", F.col("member_oid").alias("class_id")).distinct()
    return Reach(members, closure.select(F.col("member_oid").alias("class_id"), "role_oid"), itself=False)


def with_class(rows: DataFrame, closure: DataFrame | Reach, member: str) -> DataFrame:
    """Rows with the class of their member as ``_class``, and as ``_self`` the member if it reaches itself by that."""
    if not isinstance(closure, Reach):
        return rows.withColumns({"_class": F.col(member), "_self": F.lit(None).cast("bigint")})
    known = closure.members.select(
        F.col("member_oid").alias(member), F.col("class_id").alias("_class"),
        (F.col("member_oid") if closure.itself else F.lit(None).cast("bigint")).alias("_self"),
    )
    return rows.join(known, member, "left").select(*rows.columns, "_class", "_self")


def with_reach(rows: DataFrame, closure: DataFrame | Reach, role: str, into: str = "_reach") -> DataFrame:
    """Rows of :func:`with_class` with the flag 'the member reaches the role', false for NULL."""
    lists = closure.classes if isinstance(closure, Reach) else closure.withColumnRenamed("member_oid", "class_id")
    lists = lists.select(F.col("class_id").alias("_class"), F.col("role_oid").alias(role), F.lit(True).alias("_listed"))
    met = rows.join(lists, ["_class", role], "left")
    own = F.coalesce(F.col("_self") == F.col(role), F.lit(False))
    kept = [c for c in rows.columns if c not in ("_class", "_self")]
    return met.select(*kept, (F.coalesce("_listed", F.lit(False)) | own).alias(into))


def role_reach(roles: DataFrame, memberships: DataFrame, mode: str = "usage") -> Reach:
    """What :func:`role_closure` finds, in rows that grow with roles and memberships, not with their product.

    Members are of one class if they were granted the same roles, told apart by 128 bits of hash. A class leads on
    to the classes of its roles; the fixpoint runs over these few links, and each class then lists the roles of
    the classes it leads to.
    """
    known = roles.select(F.col("role_oid").alias("member_oid"), "inherits")
    edges = memberships.where(F.col("role_oid") != F.col("member_oid")).select("member_oid", "role_oid")
    edges = attach(edges, known, "member_oid", "inner")
    if mode == "usage":
        edges = edges.where("inherits")
    edges = cut_lineage(edges.select("member_oid", "role_oid").distinct())
    marks = [F.count(F.lit(1)).alias("_n")] + [
        F.bit_xor(F.xxhash64(F.col("role_oid"), F.lit(seed))).alias(f"_h{seed}") for seed in (0, 1)
    ]
    marked = edges.groupBy("member_oid").agg(*marks)
    same = ["_n", "_h0", "_h1"]
    named = marked.groupBy(*same).agg(F.min("member_oid").alias("class_id"))
    classed = marked.join(named, same).select("member_oid", "class_id")
    members = cut_lineage(attach(known.select("member_oid").distinct(), classed, "member_oid"))
    lead = members.where(F.col("class_id") == F.col("member_oid")).select("member_oid")
    direct = cut_lineage(
        attach(edges, lead, "member_oid", "left_semi").select(F.col("member_oid").alias("class_id"), "role_oid")
    )
    of_role = members.where(F.col("class_id").isNotNull()).toDF("role_oid", "_next")
    links = direct.join(of_role, "role_oid").select(F.col("class_id").alias("member_oid"), F.col("_next").alias("role_oid"))
    # a link from a class to itself leads nowhere else
    onward = _transitive(links.where(F.col("member_oid") != F.col("role_oid")).distinct())
    further = onward.join(direct.toDF("role_oid", "_far"), "role_oid").select(
        F.col("member_oid").alias("class_id"), F.col("_far").alias("role_oid")
    )
    return Reach(members, cut_lineage(direct.unionByName(further).distinct()))


def role_closure(
    roles: DataFrame, memberships: DataFrame, mode: str = "usage", members: DataFrame | None = None
) -> DataFrame:
    """(member_oid, role_oid) pairs, direct, inherited or reflexive.

    'usage' does not go on from a role without INHERIT, 'member' does. ``members`` restricts the starting
    roles. Superusers are not expanded: they reach every role (see :func:`has_role`). There may be as many
    pairs as roles squared; they come out of the last join one by one and are neither sorted nor shuffled.
    Operators that only look pairs up take :func:`role_reach` instead.
    """
    return role_reach(roles, memberships, mode).pairs(members)


def has_role(
    pairs: DataFrame, closure: DataFrame | Reach, roles: DataFrame, member: str, role: str, into: str
) -> DataFrame:
    """Add the flag 'member has role'; superusers have every role, NULL and public give false."""
    met = with_reach(with_class(pairs, closure, member), closure, role)
    supers = roles.where("is_super").select(F.col("role_oid").alias(member), F.lit(True).alias("_super"))
    flagged = attach(met, supers, member)
    asked = F.col(role).isNotNull() & (F.col(role) != PUBLIC_OID)
    return flagged.withColumn(
        into, F.col("_reach") | (F.coalesce(F.col("_super"), F.lit(False)) & F.coalesce(asked, F.lit(False)))
    ).drop("_reach", "_super")


def has_roles(
    rows: DataFrame, closure: DataFrame | Reach, roles: DataFrame, member: str, probes: dict[str, str]
) -> DataFrame:
    """Add several flags 'member has role' (role column → flag) with one look at the closure.

    Each row asks about all its roles at once: one narrow question for each role goes to the closure,
    with the row itself riding along with the first; the answers come back as the bits of a number.
    Superusers have every role, NULL and public give false.
    """
    names, columns = list(probes), rows.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    questions = F.array(
        *[
            F.struct(
                F.lit(i).alias("_bit"),
                F.col(name).cast("bigint").alias("role_oid"),
                (row if i == 0 else F.lit(None)).alias("_row"),
            )
            for i, name in enumerate(names)
        ]
    )
    asked = with_class(rows, closure, member).withColumn("_id", F.monotonically_increasing_id()).select(
        "_id", "_class", "_self", F.inline(questions)
    )
    asked = asked.where(F.col("_row").isNotNull() | F.col("role_oid").isNotNull())
    met = with_reach(asked, closure, "role_oid")
    bit = F.when(F.col("_reach"), F.expr("shiftleft(1, _bit)")).otherwise(0)
    back = met.groupBy("_id").agg(F.bit_or(bit).alias("_bits"), F.first("_row", ignorenulls=True).alias("_row"))
    supers = roles.where("is_super").select(F.col("role_oid").alias(member), F.lit(True).alias("_super"))
    flagged = attach(back.select("_row.*", "_bits"), supers, member)
    for i, name in enumerate(names):
        wanted = F.coalesce(F.col(name) != PUBLIC_OID, F.lit(False))
        held = F.col("_bits").bitwiseAND(1 << i) != 0
        flagged = flagged.withColumn(probes[name], held | (F.coalesce(F.col("_super"), F.lit(False)) & wanted))
    return flagged.drop("_bits", "_super")


def has_named_role(rows: DataFrame, closure: DataFrame | Reach, roles: DataFrame, member: str, role: str, into: str) -> DataFrame:
    """Add the flag 'member has the role of this name': only that role's members are looked at."""
    named = roles.where(F.col("role_name") == role).agg(F.max("role_oid").alias("role_oid"))
    holders = as_reach(closure).holders(named).select("member_oid")
    exists = roles.where(F.col("role_name") == role).select("role_name")
    supers = roles.where("is_super").select(F.col("role_oid").alias("member_oid"))
    supers = supers.join(F.broadcast(exists), how="cross").select("member_oid")  # one row, or none
    able = holders.union(supers).distinct().select(F.col("member_oid").alias(member), F.lit(True).alias(into))
    return attach(rows, able, member).withColumn(into, F.coalesce(F.col(into), F.lit(False)))


def acting_as(
    rows: DataFrame, role: str, into: str, closure: DataFrame | Reach, roles: DataFrame, actor: str,
    helpers: DataFrame | None = None,
) -> DataFrame:
    """Add the flag 'the named actor has the row's role'.

    What the actor reaches is read from the closure and attached by role. ``helpers`` (role_oid) are
    roles the actor will have been granted by then, with all they reach.
    """
    able = roles.where(F.col("role_name") == actor).agg(F.max("role_oid").alias("member_oid"))
    if helpers is not None:
        able = able.union(helpers.select("role_oid"))
    reach = as_reach(closure).reached_by(able).distinct().select(F.col("role_oid").alias(role), F.lit(True).alias("_can"))
    is_super = roles.where(F.col("role_name") == actor).agg(F.max("is_super")).scalar()
    flag = F.coalesce(F.col("_can"), F.lit(False)) | F.coalesce(is_super, F.lit(False))
    return attach(rows, reach, role).withColumn(into, flag).drop("_can")


def has_role_usage(pairs: DataFrame, closure: DataFrame | Reach, roles: DataFrame) -> DataFrame:
    """(parent, child) names → does the child have the parent's rights; false for unknown roles."""
    names = roles.select("role_oid", "role_name")
    parent = names.select(F.col("role_name").alias("parent"), F.col("role_oid").alias("parent_oid"))
    child = names.select(F.col("role_name").alias("child"), F.col("role_oid").alias("child_oid"))
    known = attach(attach(pairs, parent, "parent"), child, "child")
    return has_role(known, closure, roles, "child_oid", "parent_oid", "has_usage").drop(
        "parent_oid", "child_oid"
    )


def schema_function_of_role(
    requests: DataFrame, registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach
) -> DataFrame:
    """(user_oid, db_id, schema_name) requests with is_producer / is_editor / is_reader.

    Functions are looked up by their registered names, created or not; false when the schema is
    not registered, the function is vacant, or its name is not (or no longer) that of a role.
    """
    asked = with_functions(requests, registry, roles)
    flags = {f"{f}_oid": f"is_{f}" for f in FUNCTIONS}
    return has_roles(asked, closure, roles, "user_oid", flags).drop(*flags)


def with_functions(requests: DataFrame, registry: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests on (db_id, schema_name) with the ids of the roles that the registry names."""
    named = registry.select("db_id", "schema_name", *FUNCTIONS)
    for f in FUNCTIONS:
        role = roles.select(F.col("role_name").alias(f), F.col("role_oid").alias(f"{f}_oid"))
        named = attach(named, role, f, "left")
    return attach(requests, named.drop(*FUNCTIONS), ["db_id", "schema_name"], "left")


def relation_owner_members(
    requests: DataFrame, all_objects: DataFrame, roles: DataFrame, closure: DataFrame | Reach
) -> DataFrame:
    """(user, relation) requests with is_owner; false when the relation is missing."""
    relations = all_objects.where(F.col("obj_kind").isin("r", "p", "v", "m", "f", "S"))
    owners = relations.select("obj_oid", "owner_oid")
    asked = requests.join(owners, "obj_oid", "left")
    return has_role(asked, closure, roles, "user_oid", "owner_oid", "is_owner").drop("owner_oid")


def permission_label(
    requests: DataFrame, registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach
) -> DataFrame:
    """Highest function of the user on each requested created schema, by role id."""
    created = registry.where("is_created").select(
        "db_id", "schema_name", "block", "level1", "level2", *[f"{f}_oid" for f in FUNCTIONS]
    )
    asked = attach(requests, created, ["db_id", "schema_name"], "inner")
    asked = has_roles(asked, closure, roles, "user_oid", {f"{f}_oid": f"is_{f}" for f in FUNCTIONS})
    label = (
        F.when(F.col("is_producer"), F.lit("producer"))
        .when(F.col("is_editor"), F.lit("editor"))
        .when(F.col("is_reader"), F.lit("reader"))
        .otherwise(F.lit("other"))
    )
    return asked.select("user_oid", "db_id", "schema_name", "block", "level1", "level2", label.alias("permission"))


def visible_registry(
    users: DataFrame, registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach,
    admin: str = ADMIN_ROLE,
) -> DataFrame:
    """Registry rows each given user may see: all for members of the admin role, else as producer.

    A row is shown to whoever holds one of its keys: its producer (by id when the schema is
    created and the id is known, else by name), the admin role, or the superuser mark. So the
    answer is one equi-join of keys, whose output is the result itself.
    """
    admin_oid = roles.where(F.col("role_name") == admin).select(F.col("role_oid").alias("_admin"))
    by_name = roles.select(F.col("role_name").alias("producer"), F.col("role_oid").alias("_named"))
    rows = attach(registry, by_name, "producer", "left")
    key = F.when(F.col("is_created") & F.col("producer_oid").isNotNull(), F.col("producer_oid")).otherwise(
        F.col("_named")
    )
    columns = [c for c in registry.columns]
    # every row carries two keys: its own, and the mark of those who see everything
    keyed = rows.select(
        *columns,
        F.explode(F.array(key, F.lit(SUPERUSER_KEY).cast("bigint"))).alias("_key"),
    ).where(F.col("_key").isNotNull())
    asked = users.select(F.col(users.columns[0]).alias("member_oid")).distinct()
    reach = as_reach(closure).pairs(asked)
    admins = attach(
        reach.withColumnRenamed("role_oid", "_admin"), admin_oid, "_admin", "left_semi"
    ).select("member_oid")
    supers = roles.where("is_super").select(F.col("role_oid").alias("member_oid")).join(
        asked, "member_oid", "left_semi"
    )
    all_seeing = admins.union(supers).distinct()
    limited = reach.join(all_seeing, "member_oid", "left_anti")
    keys = limited.withColumnRenamed("role_oid", "_key").unionByName(
        all_seeing.withColumn("_key", F.lit(SUPERUSER_KEY).cast("bigint"))
    )
    return attach(keyed, keys, "_key", "inner").withColumnRenamed("member_oid", "user_oid").drop("_key")


def registry_visibility(
    users: DataFrame, registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach, admin: str = ADMIN_ROLE
) -> DataFrame:
    """The answer of :func:`visible_registry` in short: who sees everything is one row.

    (user_oid, sees_all, db_id, schema_name, schema_oid): a user who sees everything has a single row
    without a schema; the others have a row for each schema of theirs. So the answer has as many rows as
    there are users and true pairs of producer and schema, whoever asks.
    """
    asked = users.select(F.col(users.columns[0]).alias("user_oid")).distinct()
    judged = has_named_role(asked, closure, roles, "user_oid", admin, "_member")
    supers = roles.where("is_super").select(F.col("role_oid").alias("user_oid"), F.lit(True).alias("_super"))
    judged = attach(judged, supers, "user_oid")
    judged = judged.select("user_oid", (F.col("_member") | F.coalesce("_super", F.lit(False))).alias("sees_all"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("db_id", "bigint"), ("schema_name", "string"), ("schema_oid", "bigint"))]
    whole = judged.where("sees_all").select("user_oid", "sees_all", *nothing)
    by_name = roles.select(F.col("role_name").alias("producer"), F.col("role_oid").alias("_named"))
    own = F.when(F.col("is_created") & F.col("producer_oid").isNotNull(), F.col("producer_oid")).otherwise(F.col("_named"))
    held = attach(registry, by_name, "producer", "left").select(
        F.col("db_id").cast("bigint").alias("db_id"), "schema_name", "schema_oid", own.alias("role_oid")
    )
    limited = judged.where(~F.col("sees_all")).select(F.col("user_oid").alias("member_oid"))
    reach = _held_rows(as_reach(closure), limited, held)
    pairs = reach.select(
        F.col("member_oid").alias("user_oid"), F.lit(False).alias("sees_all"), "db_id", "schema_name", "schema_oid"
    )
    return whole.unionByName(pairs)


def _held_rows(reach: Reach, members: DataFrame, held: DataFrame) -> DataFrame:
    """Each of ``members`` (member_oid) with the rows of ``held`` whose ``role_oid`` it reaches."""
    of = reach.members.join(members, "member_oid", "left_semi")
    lists = reach.classes.join(of.select("class_id").distinct(), "class_id", "left_semi").join(held, "role_oid")
    met = of.join(lists, "class_id").drop("class_id")
    if not reach.itself:
        return met
    own = of.select("member_oid", F.col("member_oid").alias("role_oid")).join(held, "role_oid")
    return met.where(F.col("role_oid") != F.col("member_oid")).unionByName(own)


def registry_listing(registry: DataFrame) -> DataFrame:
    """Read-only listing of the registry with a dense id by database and schema name."""
    return number_rows(
        registry.select(
            "db_id", "schema_name", "block", "in_nomenclature", "level1", "level2", "is_created", "producer",
            "editor", "reader",
        ),
        [F.col("db_id"), F.col("schema_name")],
    )


def manager_listing(registry: DataFrame) -> DataFrame:
    """Created schemas with the ids of their functions and a dense id by database and schema name."""
    return number_rows(
        registry.where("is_created").select("db_id", "schema_name", "producer_oid", "editor_oid", "reader_oid"),
        [F.col("db_id"), F.col("schema_name")],
    )


def logins_missing_role(
    roles: DataFrame, memberships: DataFrame, role_name: str, direct: bool = True,
    closure: DataFrame | Reach | None = None,
) -> DataFrame:
    """Login roles to which ``role_name`` must be granted, with the command.

    ``direct``: no edge of their own, superusers skipped. Otherwise: not even member through
    other roles (``closure`` in 'member' mode). Its row count is the reference result.
    """
    target = roles.where(F.col("role_name") == role_name).select(F.col("role_oid").alias("_target"))
    logins = roles.where("can_login AND NOT is_super").select("role_oid", "role_name")
    if direct:
        links = memberships.select("member_oid", F.col("role_oid").alias("_target"))
        links = attach(links, target, "_target", "left_semi")
    else:
        links = as_reach(closure).holders(target.select(F.col("_target").alias("role_oid")))
    holders = links.select(F.col("member_oid").alias("role_oid"))
    # an unknown role gives no row at all
    missing = logins.join(holders, "role_oid", "left_anti").withColumn("_wanted", F.lit(role_name))
    exists = roles.where(F.col("role_name") == role_name).select(F.col("role_name").alias("_wanted"))
    missing = attach(missing, exists, "_wanted", "left_semi")
    return missing.select(
        F.col("role_oid").alias("member_oid"),
        F.concat(
            F.lit("GRANT "), quote_ident(F.lit(role_name)), F.lit(" TO "), quote_ident(F.col("role_name"))
        ).alias("command"),
    )


def pick_grantor(
    users: DataFrame, roles: DataFrame, memberships: DataFrame, closure: DataFrame | Reach,
    admin_options_on: str, usage: bool = False,
) -> DataFrame:
    """Role each user may act as: one with CREATEROLE it is member of, itself first, else one
    that holds the admin option on ``admin_options_on``. Ties go to the lowest name.

    ``closure`` is in 'member' mode. A first-row choice is a minimum of a struct, so it merges
    on the map side; superusers act as themselves or as the first role with CREATEROLE.
    """
    asked = users.select(F.col(users.columns[0]).alias("member_oid")).distinct()
    reach = as_reach(closure)
    creators = roles.where(F.col("can_create_role") & (F.col("inherits") if usage else F.lit(True)))
    named = F.struct(F.col("role_name").alias("n"), F.col("role_oid").alias("r"))
    valued = creators.select("role_oid", named.alias("_value"))
    by_reach = reach.least(valued)
    # itself first, if it can
    own = reach.selves().join(valued.withColumnRenamed("role_oid", "member_oid"), "member_oid")
    supers = asked.join(
        roles.where("is_super").select(F.col("role_oid").alias("member_oid")), "member_oid", "left_semi"
    ).withColumn("_all", F.lit(1))
    # superusers × creators collapses to the lowest-named creator, or the superuser itself
    lowest = valued.agg(F.min("_value").alias("_value")).where(F.col("_value").isNotNull()).select(
        F.lit(1).alias("_all"), "_value"
    ).where(F.col("_value.r").isNotNull())
    as_super = supers.join(lowest, "_all").select("member_oid", "_value")
    candidates = by_reach.withColumnRenamed("_least", "_value").unionByName(own).unionByName(as_super)
    first_creator = F.min(F.struct((F.col("_value.r") != F.col("member_oid")).alias("o"), "_value.n", "_value.r"))
    chosen = candidates.join(asked, "member_oid", "left_semi").groupBy("member_oid").agg(first_creator.alias("c")).select(
        "member_oid", F.col("c.r").alias("grantor_oid"), F.lit("create role").alias("via")
    )
    target = roles.where(F.col("role_name") == admin_options_on).select("role_oid")
    options = attach(memberships.where("admin_option"), target, "role_oid", "left_semi")
    holders = options.select(F.col("member_oid").alias("role_oid")).distinct()
    holders = attach(holders, roles.select("role_oid", "role_name"), "role_oid", "inner")
    options = reach.least(holders.select("role_oid", F.struct(F.col("role_name").alias("n"), F.col("role_oid").alias("r")).alias("_value")))
    by_option = (
        options.join(asked, "member_oid", "left_semi")
        .join(chosen.select("member_oid"), "member_oid", "left_anti")
        .select("member_oid", F.col("_least.r").alias("grantor_oid"), F.lit("admin option").alias("via"))
    )
    picked = chosen.unionByName(by_option)
    return asked.join(picked, "member_oid", "left").select(
        F.col("member_oid").alias("user_oid"),
        "grantor_oid",
        F.coalesce(F.col("via"), F.lit("FLG2")).alias("via"),
    )


def role_databases(role_dependencies: DataFrame) -> DataFrame:
    """Sorted list of the databases in which each role still owns or holds something.

    Pairs are made distinct first, so a list is bounded by the number of databases.
    """
    return (
        role_dependencies.select("role_oid", "db_id")
        .distinct()
        .groupBy("role_oid")
        .agg(F.array_sort(F.collect_list("db_id")).alias("databases"))
    )


def stale_roles(registry: DataFrame, roles: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Functions of created schemas whose role was renamed or dropped, with the correction.

    A dropped producer gives way to the schema's owner, a dropped editor or reader is cleared;
    public is skipped.
    """
    created = registry.where("is_created")
    functions = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("function"), F.col(f).alias("old_name"), F.col(f"{f}_oid").alias("old_oid")
                )
                for f in FUNCTIONS
            ]
        )
    )
    held = created.select("db_id", "schema_oid", "schema_name", functions.alias("_f")).select(
        "db_id", "schema_oid", "schema_name", "_f.*"
    )
    held = held.where(
        F.col("old_name").isNotNull()
        & ((F.col("function") == "producer") | (F.col("old_name") != "public"))
    )
    current = roles.select(F.col("role_oid").alias("old_oid"), F.col("role_name").alias("_now"))
    held = attach(held, current, "old_oid", "left")
    held = held.where(F.col("_now").isNull() | (F.col("_now") != F.col("old_name")))
    owners = namespaces.select("schema_oid", F.col("owner_oid").alias("_owner"))
    held = attach(held, owners, "schema_oid", "left")
    owner_names = roles.select(F.col("role_oid").alias("_owner"), F.col("role_name").alias("_owner_name"))
    held = attach(held, owner_names, "_owner", "left")
    renamed, is_producer = F.col("_now").isNotNull(), F.col("function") == "producer"
    return held.select(
        "schema_oid", "schema_name", "function", "old_name",
        F.when(renamed, F.col("_now")).when(is_producer, F.col("_owner_name")).alias("new_name"),
        F.when(renamed, F.col("old_oid")).when(is_producer, F.col("_owner")).alias("new_oid"),
        F.when(renamed, F.lit("rename"))
        .when(is_producer, F.lit("fall back to owner"))
        .otherwise(F.lit("clear"))
        .alias("action"),
    )


def admin_membership_gaps(
    registry: DataFrame, roles: DataFrame, memberships: DataFrame, closure: DataFrame | Reach,
    admin: str = ADMIN_ROLE,
) -> DataFrame:
    """Producers of created schemas that the admin role is not a direct member of.

    They are to be granted to it, unless they are themselves members of it (error TVA2).
    ``closure`` is in 'member' mode. Roles are looked up by the registered name.
    """
    named = roles.select(F.col("role_name").alias("producer"), F.col("role_oid"), "is_super")
    held = attach(
        registry.where(F.col("is_created") & (F.col("producer") != admin)).select("schema_name", "schema_oid", "producer"),
        named, "producer", "inner",
    ).where("NOT is_super")
    admin_oid = roles.where(F.col("role_name") == admin).select(F.col("role_oid").alias("_admin"))
    direct = attach(
        memberships.select("role_oid", F.col("member_oid").alias("_admin")), admin_oid, "_admin", "left_semi"
    ).select("role_oid").distinct()
    missing = held.join(direct, "role_oid", "left_anti")
    members_of = as_reach(closure).holders(admin_oid.select(F.col("_admin").alias("role_oid")))
    circular = members_of.select(F.col("member_oid").alias("role_oid"), F.lit("TVA2").alias("error")).distinct()
    return missing.join(circular, "role_oid", "left").select(
        "schema_name", "schema_oid", "producer", "role_oid", "error",
        F.when(
            F.col("error").isNull(),
            F.concat(F.lit("GRANT "), quote_ident(F.col("producer")), F.lit(" TO "), quote_ident(F.lit(admin))),
        ).alias("command"),
    )


def invalid_producers(registry: DataFrame, roles: DataFrame) -> DataFrame:
    """Producers that are plain login roles (TA3) and producers that do not exist (to be created)."""
    named = roles.select(F.col("role_name").alias("producer"), "can_login", "is_super")
    held = attach(
        registry.where("is_created").select("schema_name", "schema_oid", "producer"), named, "producer", "left"
    )
    return held.select(
        "schema_name", "schema_oid", "producer",
        F.when(F.col("can_login").isNull(), F.lit("create role"))
        .when(F.col("can_login") & ~F.col("is_super"), F.lit("TA3"))
        .alias("finding"),
    ).where(F.col("finding").isNotNull())
