"""Oracle SQL: the rules restated relation by relation, for the other engine."""

from __future__ import annotations

from grantlens.functions.sqltext import QUOTED_KEYWORDS
from harness.inputs import with_inputs

_WORDS = ",".join(f"'{w}'" for w in QUOTED_KEYWORDS)


def q(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x},'^[a-z_][a-z0-9_]*$') AND {x} NOT IN ({_WORDS}) THEN {x} "
        f"ELSE '\"'||replace({x},'\"','\"\"')||'\"' END"
    )


PRIV = """priv(code, privilege) AS (VALUES ('r','SELECT'),('a','INSERT'),('w','UPDATE'),('d','DELETE'),
('D','TRUNCATE'),('x','REFERENCES'),('t','TRIGGER'),('U','USAGE'),('C','CREATE'),('X','EXECUTE'),('c','CONNECT'),('T','TEMPORARY'))"""

KIND = """kind(kind, cls, alt, owner, editor, reader, pub, base) AS (VALUES
('r','TABLE','TABLE','rawdDxt','rawd','r','',true),('p','TABLE','TABLE','rawdDxt','rawd','r','',true),
('v','TABLE','VIEW','rawdDxt','rawd','r','',false),('m','TABLE','MATERIALIZED VIEW','rawdDxt','rawd','r','',true),
('f','TABLE','FOREIGN TABLE','rawdDxt','rawd','r','',true),('S','SEQUENCE','SEQUENCE','rwU','rU','r','',false),
('X','ROUTINE','ROUTINE','X','','','X',false),('T','TYPE','TYPE','U','','','U',false),('d','TYPE','DOMAIN','U','','','U',false),
('N','SCHEMA','SCHEMA','UC','U','U','',false),('A','TABLE','TABLE','','','','',false))"""

USAGE = """usage_edges AS (SELECT m.member_oid, m.role_oid FROM memberships m JOIN roles r ON r.role_oid=m.member_oid WHERE r.inherits),
usage_reach(member_oid, role_oid) AS (SELECT role_oid, role_oid FROM roles UNION
 SELECT w.member_oid, e.role_oid FROM usage_reach w JOIN usage_edges e ON e.member_oid=w.role_oid)"""
MEMBER = """member_reach(member_oid, role_oid) AS (SELECT role_oid, role_oid FROM roles UNION
 SELECT w.member_oid, e.role_oid FROM member_reach w JOIN memberships e ON e.member_oid=w.role_oid)"""
SUPERS = "supers AS (SELECT role_oid FROM roles WHERE is_super)"


def can(member: str, role: str, reach: str = "usage_reach") -> str:
    """Truth of 'member has role', for non-NULL roles other than public."""
    return (
        f"(({member},{role}) IN (SELECT (member_oid,role_oid) FROM {reach}) OR "
        f"({member} IN (SELECT role_oid FROM supers) AND {role}<>0))"
    )


def has(member: str, role: str, reach: str = "usage_reach") -> str:
    return f"coalesce({can(member, role, reach)}, false)"


# rights of each role, and of owners that lost some
RIGHTS = f"""{PRIV},
{KIND},
a3 AS (SELECT DISTINCT db_id, schema_oid, obj_kind, obj_oid, column_name, grantee_oid AS role_oid, privilege, 'GRANT' AS verb
 FROM all_acl JOIN priv ON contains(codes, code) WHERE grantee_oid<>0 AND (obj_kind='A' OR grantee_oid<>owner_oid)),
a4 AS (SELECT o.db_id, o.schema_oid, o.obj_kind, o.obj_oid, CAST(NULL AS VARCHAR) AS column_name, o.owner_oid AS role_oid, p.privilege, 'REVOKE' AS verb
 FROM all_objects o JOIN kind k ON k.kind=o.obj_kind JOIN priv p ON contains(k.owner, p.code)
 WHERE o.has_acl AND NOT EXISTS (SELECT 1 FROM all_acl a WHERE a.obj_kind=o.obj_kind AND a.obj_oid=o.obj_oid AND a.grantee_oid=o.owner_oid AND contains(a.codes, p.code))),
a34 AS (SELECT * FROM a3 UNION ALL SELECT * FROM a4),
a5 AS (SELECT DISTINCT db_id, schema_oid, obj_kind, obj_oid, column_name, CAST(0 AS BIGINT) AS role_oid, privilege, 'GRANT' AS verb
 FROM all_acl JOIN priv ON contains(codes, code) WHERE grantee_oid=0 AND obj_kind IN ('N','r','p','v','m','f','S','A'))"""

NAMES = f"""names AS (SELECT k.cls, o.obj_oid, o.obj_kind, n.schema_name, CASE WHEN o.obj_kind='N' THEN {q('n.schema_name')}
 WHEN o.obj_kind='X' THEN {q('n.schema_name')}||'.'||{q('o.obj_name')}||'()' ELSE {q('n.schema_name')}||'.'||{q('o.obj_name')} END AS target
 FROM all_objects o JOIN kind k ON k.kind=o.obj_kind LEFT JOIN namespaces n ON n.schema_oid=o.schema_oid),
rolenames AS (SELECT role_oid, {q('role_name')} AS ref FROM roles UNION ALL SELECT 0, 'public')"""


def rendered(source: str) -> str:
    return f"""SELECT s.*, k.cls AS object_class, s.verb||' '||s.privilege||CASE WHEN s.column_name IS NULL THEN '' ELSE ' ('||{q('s.column_name')}||')' END
 ||' ON '||k.cls||' '||n.target||CASE s.verb WHEN 'GRANT' THEN ' TO ' ELSE ' FROM ' END||u.ref AS command
 FROM {source} s JOIN kind k ON k.kind=s.obj_kind LEFT JOIN names n ON n.cls=k.cls AND n.obj_oid=s.obj_oid LEFT JOIN rolenames u ON u.role_oid=s.role_oid"""


LIVE = """live AS (SELECT r.db_id, r.schema_oid, r.schema_name, p.role_oid AS producer_oid,
 CASE WHEN r.editor='public' THEN 0 ELSE e.role_oid END AS editor_oid, CASE WHEN r.reader='public' THEN 0 ELSE l.role_oid END AS reader_oid
 FROM registry r LEFT JOIN roles p ON p.role_oid=r.producer_oid LEFT JOIN roles e ON e.role_oid=r.editor_oid LEFT JOIN roles l ON l.role_oid=r.reader_oid WHERE r.is_created)"""

AUDITED = f"""{LIVE},
audited AS (SELECT l.db_id, o.obj_kind, o.obj_oid, o.obj_name, o.owner_oid, o.has_acl, l.schema_name, l.producer_oid, l.editor_oid, l.reader_oid FROM all_objects o JOIN live l ON l.schema_oid=o.schema_oid WHERE o.obj_kind<>'N'
 UNION ALL SELECT l.db_id, o.obj_kind, o.obj_oid, o.obj_name, o.owner_oid, o.has_acl, l.schema_name, l.producer_oid, l.editor_oid, l.reader_oid FROM all_objects o JOIN live l ON l.db_id=o.db_id AND l.schema_name=o.obj_name WHERE o.obj_kind='N')"""

D2 = """SELECT CAST(db_id AS BIGINT) AS db_id, schema_name, obj_kind, CAST(obj_oid AS BIGINT) AS obj_oid, CAST(NULL AS VARCHAR) AS column_name, CAST(owner_oid AS BIGINT) AS role_oid, CAST(producer_oid AS BIGINT) AS other_oid,
 'owner' AS "function", CAST(NULL AS VARCHAR) AS privilege, 'owner' AS anomaly, true AS is_critical FROM audited WHERE NOT owner_oid=producer_oid"""

D3 = """SELECT CAST(r.db_id AS BIGINT) AS db_id, r.schema_name, 'default '||d.obj_type AS obj_kind, CAST(NULL AS BIGINT) AS obj_oid, CAST(NULL AS VARCHAR) AS column_name, CAST(d.grantee_oid AS BIGINT) AS role_oid,
 CAST(d.grantor_oid AS BIGINT) AS other_oid, CAST(NULL AS VARCHAR) AS "function", p.privilege, 'default privilege' AS anomaly, false AS is_critical
 FROM default_acl d JOIN registry r ON r.schema_oid=d.schema_oid JOIN priv p ON contains(d.codes, p.code) WHERE r.is_created AND d.obj_type IN ('r','S','f','T')"""

D4_CTES = """wanted AS (
 SELECT db_id, obj_kind, obj_oid, schema_name, "function", role_oid, privilege FROM (
  SELECT a.*, 'owner' AS "function", a.owner_oid AS role_oid, k.owner AS codes FROM audited a JOIN kind k ON k.kind=a.obj_kind WHERE a.has_acl
  UNION ALL SELECT a.*, 'reader', a.reader_oid, k.reader FROM audited a JOIN kind k ON k.kind=a.obj_kind
  UNION ALL SELECT a.*, 'editor', a.editor_oid, k.editor FROM audited a JOIN kind k ON k.kind=a.obj_kind
  UNION ALL SELECT a.*, 'public', 0, k.pub FROM audited a JOIN kind k ON k.kind=a.obj_kind WHERE a.has_acl
  UNION ALL SELECT a.*, 'fixed', f.role_oid, f.codes FROM audited a JOIN fixed_grants f ON f.schema_name=a.schema_name AND f.obj_name=a.obj_name AND f.obj_kind=a.obj_kind
 ) x JOIN priv ON contains(x.codes, priv.code) WHERE role_oid IS NOT NULL),
effective AS (SELECT DISTINCT c.obj_kind, c.obj_oid, c.column_name, c.grantee_oid AS role_oid, p.privilege, c.grantable,
  CASE WHEN c.obj_kind='N' THEN t.schema_name ELSE l.schema_name END AS schema_name, CASE WHEN c.obj_kind='N' THEN t.db_id ELSE l.db_id END AS db_id
  FROM all_acl c JOIN priv p ON contains(c.codes, p.code)
  LEFT JOIN audited t ON c.obj_kind='N' AND t.obj_kind='N' AND t.obj_oid=c.obj_oid
  LEFT JOIN live l ON c.obj_kind<>'N' AND l.schema_oid=c.schema_oid
  WHERE CASE WHEN c.obj_kind='N' THEN t.schema_name ELSE l.schema_name END IS NOT NULL)"""

D4 = """SELECT DISTINCT CAST(coalesce(e.db_id, w.db_id) AS BIGINT) AS db_id, coalesce(e.schema_name, w.schema_name) AS schema_name, coalesce(e.obj_kind, w.obj_kind) AS obj_kind, CAST(coalesce(e.obj_oid, w.obj_oid) AS BIGINT) AS obj_oid, e.column_name,
 CAST(coalesce(e.role_oid, w.role_oid) AS BIGINT) AS role_oid, CAST(NULL AS BIGINT) AS other_oid, CASE WHEN e.privilege IS NULL THEN w."function" END AS "function", coalesce(e.privilege, w.privilege) AS privilege,
 CASE WHEN e.privilege IS NULL THEN 'missing' WHEN w.privilege IS NULL THEN CASE WHEN e.grantable THEN 'extra with grant option' ELSE 'extra' END ELSE 'grant option' END AS anomaly,
 e.privilege IS NULL AND w."function"='fixed' AS is_critical
 FROM effective e FULL OUTER JOIN wanted w ON e.obj_kind=w.obj_kind AND e.obj_oid=w.obj_oid AND e.column_name IS NULL AND e.role_oid=w.role_oid AND e.privilege=w.privilege
 WHERE e.privilege IS NULL OR w.privilege IS NULL OR e.grantable"""

SOURCES = """edges AS (SELECT vs.view_oid, vs.source_oid, v.obj_kind AS view_kind, l.db_id, l.schema_name, l.producer_oid, s.schema_oid AS source_schema_oid
 FROM view_sources vs JOIN all_objects v ON v.obj_oid=vs.view_oid AND v.obj_kind IN ('v','m') JOIN all_objects s ON s.obj_oid=vs.source_oid AND s.obj_kind IN ('r','p','v','m','f','S')
 JOIN live l ON l.schema_oid=v.schema_oid)"""

D5 = f"""SELECT DISTINCT CAST(e.db_id AS BIGINT) AS db_id, e.schema_name, e.view_kind AS obj_kind, CAST(e.view_oid AS BIGINT) AS obj_oid, CAST(NULL AS VARCHAR) AS column_name, CAST(e.producer_oid AS BIGINT) AS role_oid, CAST(e.source_oid AS BIGINT) AS other_oid,
 CAST(NULL AS VARCHAR) AS "function", CAST(NULL AS VARCHAR) AS privilege, 'view source' AS anomaly, false AS is_critical
 FROM edges e JOIN registry r ON r.schema_oid=e.source_schema_oid
 WHERE r.schema_name<>e.schema_name AND NOT {can('e.producer_oid', 'r.producer_oid')}
 AND (r.editor_oid IS NULL OR NOT {has('e.producer_oid', 'r.editor_oid')}) AND (r.reader_oid IS NULL OR NOT {has('e.producer_oid', 'r.reader_oid')})"""

# (role or public, object) → privilege, from ACLs and from the built-in defaults
HOLDS = """holds AS (SELECT DISTINCT a.obj_oid, a.grantee_oid AS role_oid, p.privilege FROM all_acl a JOIN priv p ON contains(a.codes, p.code) WHERE a.column_name IS NULL AND a.obj_kind<>'N'
 UNION SELECT o.obj_oid, o.owner_oid, p.privilege FROM all_objects o JOIN kind k ON k.kind=o.obj_kind JOIN priv p ON contains(k.owner, p.code) WHERE NOT o.has_acl AND o.obj_kind<>'N'
 UNION SELECT o.obj_oid, 0, p.privilege FROM all_objects o JOIN kind k ON k.kind=o.obj_kind JOIN priv p ON contains(k.pub, p.code) WHERE NOT o.has_acl AND o.obj_kind<>'N')"""

D6 = f"""SELECT DISTINCT CAST(e.db_id AS BIGINT) AS db_id, e.schema_name, e.view_kind AS obj_kind, CAST(e.view_oid AS BIGINT) AS obj_oid, CAST(NULL AS VARCHAR) AS column_name, CAST(e.producer_oid AS BIGINT) AS role_oid, CAST(e.source_oid AS BIGINT) AS other_oid,
 CASE WHEN r.schema_name IS NULL THEN NULL WHEN r.reader_oid IS NULL THEN 'set reader' ELSE 'grant reader' END AS "function", 'SELECT' AS privilege, 'view source access' AS anomaly, false AS is_critical
 FROM edges e LEFT JOIN registry r ON r.schema_oid=e.source_schema_oid WHERE e.producer_oid IS NOT NULL AND e.producer_oid NOT IN (SELECT role_oid FROM supers)
 AND NOT EXISTS (SELECT 1 FROM holds h WHERE h.obj_oid=e.source_oid AND h.privilege='SELECT' AND h.role_oid=0)
 AND NOT EXISTS (SELECT 1 FROM holds h JOIN usage_reach u ON u.role_oid=h.role_oid WHERE h.obj_oid=e.source_oid AND h.privilege='SELECT' AND u.member_oid=e.producer_oid)"""


def diagnostics() -> dict[str, str]:
    base = f"{PRIV},\n{KIND},\n{AUDITED}"
    graph = f"{USAGE},\n{SUPERS}"
    everything = f"{D2} UNION ALL {D3} UNION ALL {D4} UNION ALL {D5} UNION ALL {D6}"
    all_parts = f"{base},\n{D4_CTES},\n{graph},\n{SOURCES},\n{HOLDS}"
    return {
        "diagnose_rights": with_inputs(everything, all_parts, recursive=True),
        "diagnose_targets": with_inputs(
            f"""SELECT x.* FROM ({everything}) x WHERE EXISTS (SELECT 1 FROM diagnosis_targets t WHERE t.db_id=x.db_id AND t.schema_name=x.schema_name)
 UNION ALL SELECT CAST(t.db_id AS BIGINT), t.schema_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'FDD1', true FROM (SELECT DISTINCT db_id, schema_name FROM diagnosis_targets) t
 WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.is_created AND r.db_id=t.db_id AND r.schema_name=t.schema_name)""",
            all_parts, recursive=True,
        ),
        "owner_anomalies": with_inputs(D2, AUDITED),
        "default_acl_anomalies": with_inputs(D3, PRIV),
        "privilege_anomalies": with_inputs(D4, f"{base},\n{D4_CTES}"),
        "view_source_anomalies": with_inputs(D5, f"{LIVE},\n{graph},\n{SOURCES}", recursive=True),
        "view_source_access": with_inputs(D6, f"{PRIV},\n{KIND},\n{LIVE},\n{graph},\n{SOURCES},\n{HOLDS}", recursive=True),
        "effective_privileges": with_inputs(
            """SELECT DISTINCT CAST(user_oid AS BIGINT) AS user_oid, CAST(obj_oid AS BIGINT) AS obj_oid, privilege FROM (
 SELECT r.user_oid, r.obj_oid, h.privilege FROM object_requests r JOIN holds h ON h.obj_oid=r.obj_oid AND h.role_oid=0
 UNION ALL SELECT r.user_oid, r.obj_oid, h.privilege FROM object_requests r JOIN holds h ON h.obj_oid=r.obj_oid JOIN usage_reach u ON u.member_oid=r.user_oid AND u.role_oid=h.role_oid
 UNION ALL SELECT r.user_oid, r.obj_oid, p.privilege FROM object_requests r JOIN supers s ON s.role_oid=r.user_oid JOIN all_objects o ON o.obj_oid=r.obj_oid AND o.obj_kind<>'N' JOIN kind k ON k.kind=o.obj_kind JOIN priv p ON contains(k.owner, p.code))""",
            f"{PRIV},\n{KIND},\n{graph},\n{HOLDS}", recursive=True,
        ),
    }


def acl() -> dict[str, str]:
    cols = "CAST(db_id AS BIGINT) AS db_id, CAST(schema_oid AS BIGINT) AS schema_oid, obj_kind, CAST(obj_oid AS BIGINT) AS obj_oid, column_name, CAST(role_oid AS BIGINT) AS role_oid, privilege, verb"
    typed = """asked AS (SELECT obj_oid, obj_type, CASE WHEN obj_type IN ('table','view','materialized view','foreign table','partitioned table') THEN 'TABLE'
 WHEN obj_type='sequence' THEN 'SEQUENCE' WHEN obj_type IN ('function','aggregate','procedure','routine') THEN 'ROUTINE' WHEN obj_type IN ('type','domain') THEN 'TYPE' END AS cls FROM object_reset_requests)"""
    answer = "CAST(x.obj_oid AS BIGINT) AS obj_oid, x.column_name, CAST(x.role_oid AS BIGINT) AS role_oid, x.verb, x.privilege, CAST(NULL AS VARCHAR) AS error"
    none = "CAST(obj_oid AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
    return {
        "explode_acl": with_inputs(
            "SELECT obj_kind, CAST(obj_oid AS BIGINT) AS obj_oid, column_name, ''||coalesce(owner_oid, grantee_oid) AS grantor, ''||grantee_oid AS grantee, privilege, grantable FROM all_acl JOIN priv ON contains(codes, code)", PRIV),
        "expand_privilege_codes": with_inputs(
            "SELECT obj_kind, CAST(obj_oid AS BIGINT) AS obj_oid, column_name, CAST(grantee_oid AS BIGINT) AS grantee_oid, grantable, privilege FROM all_acl JOIN priv ON contains(codes, code)", PRIV),
        "role_privileges": with_inputs(f"SELECT {cols} FROM a3", RIGHTS),
        "owner_missing_privileges": with_inputs(f"SELECT {cols} FROM a4", RIGHTS),
        "public_privileges": with_inputs(f"SELECT {cols} FROM a5", RIGHTS),
        "object_privileges": with_inputs(
            f"""SELECT {answer} FROM a34 x JOIN kind k ON k.kind=x.obj_kind WHERE x.obj_kind<>'N' AND EXISTS (SELECT 1 FROM asked a WHERE a.obj_oid=x.obj_oid AND a.cls=k.cls)
 UNION ALL SELECT {none}, 'FSR0' FROM asked WHERE cls IS NULL""", f"{RIGHTS},\n{typed}"),
        "object_public_privileges": with_inputs(
            f"""SELECT {answer} FROM a5 x JOIN kind k ON k.kind=x.obj_kind WHERE x.obj_kind<>'N' AND EXISTS (SELECT 1 FROM asked a WHERE a.obj_oid=x.obj_oid AND a.cls=k.cls AND a.cls IN ('TABLE','SEQUENCE'))
 UNION ALL SELECT {none}, 'FSP0' FROM asked WHERE cls IS NULL OR cls NOT IN ('TABLE','SEQUENCE')""", f"{RIGHTS},\n{typed}"),
        "render_commands": with_inputs(
            f"SELECT CAST(db_id AS BIGINT) AS db_id, CAST(obj_oid AS BIGINT) AS obj_oid, object_class, CAST(role_oid AS BIGINT) AS role_oid, command FROM ({rendered('a34')})", f"{RIGHTS},\n{NAMES}"),
        "invert_commands": with_inputs(
            f"""SELECT command, CASE WHEN regexp_matches(command,'^GRANT') THEN regexp_replace(regexp_replace(command,'^GRANT','REVOKE'),'\\sTO\\s',' FROM ')
 WHEN regexp_matches(command,'^REVOKE') THEN regexp_replace(regexp_replace(command,'^REVOKE','GRANT'),'\\sFROM\\s',' TO ') END AS inverted,
 CASE WHEN NOT regexp_matches(command,'^(GRANT|REVOKE)') THEN 'FGR1' END AS error
 FROM (SELECT command FROM ({rendered('a34')}) WHERE command IS NOT NULL UNION ALL SELECT lower(command) FROM ({rendered('a4')}) WHERE command IS NOT NULL)""", f"{RIGHTS},\n{NAMES}"),
        "resolve_relation_names": with_inputs(
            """SELECT CAST(r.obj_oid AS BIGINT) AS obj_oid, n.schema_name, CASE WHEN n.schema_name IS NOT NULL THEN o.obj_name END AS relation_name
 FROM (SELECT DISTINCT obj_oid FROM object_requests) r LEFT JOIN all_objects o ON o.obj_oid=r.obj_oid AND o.obj_kind IN ('r','p','v','m','f','S') LEFT JOIN namespaces n ON n.schema_oid=o.schema_oid"""),
    }


def roles() -> dict[str, str]:
    graph = f"{USAGE},\n{SUPERS}"
    by_name = """named AS (SELECT r.db_id, r.schema_name, p.role_oid AS producer_oid, e.role_oid AS editor_oid, l.role_oid AS reader_oid FROM registry r
 LEFT JOIN roles p ON p.role_name=r.producer LEFT JOIN roles e ON e.role_name=r.editor LEFT JOIN roles l ON l.role_name=r.reader)"""
    held = """held AS (SELECT r.schema_oid, r.schema_name, x."function", x.old_name, x.old_oid FROM (
 SELECT schema_oid, 'producer' AS "function", producer AS old_name, producer_oid AS old_oid FROM registry WHERE is_created UNION ALL
 SELECT schema_oid, 'editor', editor, editor_oid FROM registry WHERE is_created AND editor<>'public' UNION ALL
 SELECT schema_oid, 'reader', reader, reader_oid FROM registry WHERE is_created AND reader<>'public') x JOIN registry r ON r.schema_oid=x.schema_oid WHERE x.old_name IS NOT NULL)"""
    return {
        "role_closure": with_inputs(
            "SELECT 'usage' AS mode, CAST(member_oid AS BIGINT) AS member_oid, CAST(role_oid AS BIGINT) AS role_oid FROM usage_reach UNION ALL SELECT 'member', CAST(member_oid AS BIGINT), CAST(role_oid AS BIGINT) FROM member_reach",
            f"{USAGE},\n{MEMBER}", recursive=True),
        "has_role_usage": with_inputs(
            f"""SELECT x.parent, x.child, coalesce(CASE WHEN p.role_oid IS NULL OR c.role_oid IS NULL THEN false ELSE {can('c.role_oid', 'p.role_oid')} END, false) AS has_usage
 FROM role_pairs x LEFT JOIN roles p ON p.role_name=x.parent LEFT JOIN roles c ON c.role_name=x.child""", graph, recursive=True),
        "schema_function_of_role": with_inputs(
            f"""SELECT CAST(a.user_oid AS BIGINT) AS user_oid, CAST(a.db_id AS BIGINT) AS db_id, a.schema_name, {has('a.user_oid', 'n.producer_oid')} AS is_producer, {has('a.user_oid', 'n.editor_oid')} AS is_editor, {has('a.user_oid', 'n.reader_oid')} AS is_reader
 FROM access_requests a LEFT JOIN named n ON n.db_id=a.db_id AND n.schema_name=a.schema_name""", f"{graph},\n{by_name}", recursive=True),
        "relation_owner_members": with_inputs(
            f"""SELECT CAST(a.user_oid AS BIGINT) AS user_oid, CAST(a.obj_oid AS BIGINT) AS obj_oid, {has('a.user_oid', 'o.owner_oid')} AS is_owner
 FROM object_requests a LEFT JOIN all_objects o ON o.obj_oid=a.obj_oid AND o.obj_kind IN ('r','p','v','m','f','S')""", graph, recursive=True),
        "permission_label": with_inputs(
            f"""SELECT CAST(a.user_oid AS BIGINT) AS user_oid, CAST(r.db_id AS BIGINT) AS db_id, r.schema_name, r.block, r.level1, r.level2, CASE WHEN {can('a.user_oid', 'r.producer_oid')} THEN 'producer' WHEN {can('a.user_oid', 'r.editor_oid')} THEN 'editor'
 WHEN {can('a.user_oid', 'r.reader_oid')} THEN 'reader' ELSE 'other' END AS permission FROM access_requests a JOIN registry r ON r.db_id=a.db_id AND r.schema_name=a.schema_name WHERE r.is_created""", graph, recursive=True),
        "visible_registry": with_inputs(
            """SELECT CAST(u.role_oid AS BIGINT) AS user_oid, CAST(r.db_id AS BIGINT) AS db_id, r.schema_name, CAST(r.schema_oid AS BIGINT) AS schema_oid, r.producer FROM group_actors u, registry r LEFT JOIN roles p ON p.role_name=r.producer
 WHERE u.role_oid IN (SELECT role_oid FROM supers) OR u.role_oid IN (SELECT member_oid FROM usage_reach WHERE role_oid=10)
 OR (u.role_oid, CASE WHEN r.is_created AND r.producer_oid IS NOT NULL THEN r.producer_oid ELSE p.role_oid END) IN (SELECT (member_oid, role_oid) FROM usage_reach)""", graph, recursive=True),
        "registry_visibility": with_inputs(
            """SELECT CAST(role_oid AS BIGINT) AS user_oid, true AS sees_all, CAST(NULL AS BIGINT) AS db_id, CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS BIGINT) AS schema_oid FROM roles WHERE role_oid IN (SELECT * FROM all_seeing)
 UNION ALL SELECT CAST(w.member_oid AS BIGINT), false, CAST(r.db_id AS BIGINT), r.schema_name, CAST(r.schema_oid AS BIGINT) FROM registry r LEFT JOIN roles p ON p.role_name=r.producer
 JOIN usage_reach w ON w.role_oid=CASE WHEN r.is_created AND r.producer_oid IS NOT NULL THEN r.producer_oid ELSE p.role_oid END WHERE w.member_oid NOT IN (SELECT * FROM all_seeing)""",
            f"{graph},\nall_seeing AS (SELECT role_oid FROM supers UNION SELECT member_oid FROM usage_reach WHERE role_oid=10)", recursive=True),
        "registry_listing": with_inputs(
            "SELECT row_number() OVER (ORDER BY db_id, schema_name) AS id, CAST(db_id AS BIGINT) AS db_id, schema_name, block, in_nomenclature, level1, level2, is_created, producer, editor, reader FROM registry"),
        "manager_listing": with_inputs(
            "SELECT row_number() OVER (ORDER BY db_id, schema_name) AS id, CAST(db_id AS BIGINT) AS db_id, schema_name, CAST(producer_oid AS BIGINT) AS producer_oid, CAST(editor_oid AS BIGINT) AS editor_oid, CAST(reader_oid AS BIGINT) AS reader_oid FROM registry WHERE is_created"),
        "logins_missing_role": with_inputs(
            f"""SELECT 'direct' AS mode, CAST(r.role_oid AS BIGINT) AS member_oid, 'GRANT g_consult TO '||{q('r.role_name')} AS command FROM roles r WHERE r.can_login AND NOT r.is_super AND r.role_oid NOT IN (SELECT member_oid FROM memberships WHERE role_oid=12)
 UNION ALL SELECT 'indirect', CAST(r.role_oid AS BIGINT), 'GRANT g_consult TO '||{q('r.role_name')} FROM roles r WHERE r.can_login AND NOT r.is_super AND r.role_oid NOT IN (SELECT member_oid FROM member_reach WHERE role_oid=12)""", MEMBER, recursive=True),
        "pick_grantor": with_inputs(
            """SELECT CAST(u.role_oid AS BIGINT) AS user_oid, CAST(coalesce(c.role_oid, o.role_oid) AS BIGINT) AS grantor_oid, CASE WHEN c.role_oid IS NOT NULL THEN 'create role' WHEN o.role_oid IS NOT NULL THEN 'admin option' ELSE 'FLG2' END AS via
 FROM roles u LEFT JOIN (SELECT member_oid, role_oid FROM (SELECT w.member_oid, w.role_oid, row_number() OVER (PARTITION BY w.member_oid ORDER BY (w.role_oid<>w.member_oid), r.role_name) AS rn
  FROM (SELECT member_oid, role_oid FROM member_reach UNION SELECT s.role_oid, x.role_oid FROM supers s, roles x) w JOIN roles r ON r.role_oid=w.role_oid WHERE r.can_create_role) WHERE rn=1) c ON c.member_oid=u.role_oid
 LEFT JOIN (SELECT member_oid, role_oid FROM (SELECT w.member_oid, w.role_oid, row_number() OVER (PARTITION BY w.member_oid ORDER BY r.role_name) AS rn FROM member_reach w JOIN roles r ON r.role_oid=w.role_oid
  WHERE w.role_oid IN (SELECT member_oid FROM memberships WHERE admin_option AND role_oid=100)) WHERE rn=1) o ON o.member_oid=u.role_oid""", f"{MEMBER},\n{SUPERS}", recursive=True),
        "role_databases": with_inputs(
            "SELECT CAST(role_oid AS BIGINT) AS role_oid, string_agg(''||db_id, ',' ORDER BY db_id) AS databases FROM (SELECT DISTINCT role_oid, db_id FROM role_dependencies) GROUP BY role_oid"),
        "stale_roles": with_inputs(
            """SELECT CAST(h.schema_oid AS BIGINT) AS schema_oid, h.schema_name, h."function", h.old_name, CASE WHEN r.role_oid IS NOT NULL THEN r.role_name WHEN h."function"='producer' THEN w.role_name END AS new_name,
 CAST(CASE WHEN r.role_oid IS NOT NULL THEN h.old_oid WHEN h."function"='producer' THEN n.owner_oid END AS BIGINT) AS new_oid,
 CASE WHEN r.role_oid IS NOT NULL THEN 'rename' WHEN h."function"='producer' THEN 'fall back to owner' ELSE 'clear' END AS action
 FROM held h LEFT JOIN roles r ON r.role_oid=h.old_oid LEFT JOIN namespaces n ON n.schema_oid=h.schema_oid LEFT JOIN roles w ON w.role_oid=n.owner_oid WHERE r.role_name IS NULL OR r.role_name<>h.old_name""", held),
        "admin_membership_gaps": with_inputs(
            f"""SELECT g.schema_name, CAST(g.schema_oid AS BIGINT) AS schema_oid, g.producer, CAST(p.role_oid AS BIGINT) AS role_oid, CASE WHEN p.role_oid IN (SELECT member_oid FROM member_reach WHERE role_oid=10) THEN 'TVA2' END AS error,
 CASE WHEN p.role_oid NOT IN (SELECT member_oid FROM member_reach WHERE role_oid=10) THEN 'GRANT '||{q('g.producer')}||' TO g_admin' END AS command
 FROM registry g JOIN roles p ON p.role_name=g.producer WHERE g.is_created AND g.producer<>'g_admin' AND NOT p.is_super AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.role_oid=p.role_oid AND m.member_oid=10)""", MEMBER, recursive=True),
        "invalid_producers": with_inputs(
            """SELECT g.schema_name, CAST(g.schema_oid AS BIGINT) AS schema_oid, g.producer, CASE WHEN p.role_oid IS NULL THEN 'create role' ELSE 'TA3' END AS finding FROM registry g LEFT JOIN roles p ON p.role_name=g.producer
 WHERE g.is_created AND (p.role_oid IS NULL OR (p.can_login AND NOT p.is_super))"""),
    }


PLAN = f"{RIGHTS},\n{NAMES}"
OWNER_CMD = "'ALTER '||k.alt||' '||n.target||' OWNER TO '||u.ref"
CMD = (
    f"CASE WHEN s.verb='OWNER' THEN {OWNER_CMD} ELSE s.verb||' '||s.privilege||CASE WHEN s.column_name IS NULL THEN '' ELSE ' ('||{q('s.column_name')}||')' END"
    "||' ON '||k.cls||' '||n.target||CASE s.verb WHEN 'GRANT' THEN ' TO ' ELSE ' FROM ' END||u.ref END"
)


def commands(source: str, columns: str) -> str:
    return f"""SELECT {columns}, {CMD} AS command FROM {source} s JOIN kind k ON k.kind=s.obj_kind
 LEFT JOIN names n ON n.cls=k.cls AND n.obj_oid=s.obj_oid LEFT JOIN rolenames u ON u.role_oid=s.role_oid"""


def big(*names: str, of: str = "s") -> str:
    return ", ".join(f"CAST({of}.{n} AS BIGINT) AS {n}" for n in names)


TABLES_EDIT, TABLES_READ = "'SELECT, INSERT, UPDATE, DELETE'", "'SELECT'"
# standard rights as one row per object (x.editor_oid, x.reader_oid)
STANDARD_LIST = """CASE WHEN x.obj_kind='N' THEN 'USAGE' WHEN x.obj_kind='S' THEN CASE f.fn WHEN 'editor' THEN 'SELECT, USAGE' ELSE 'SELECT' END
 ELSE CASE f.fn WHEN 'editor' THEN 'SELECT, INSERT, UPDATE, DELETE' ELSE 'SELECT' END END"""
FN = "fn(fn) AS (VALUES ('editor'),('reader'))"


def schema_commands(source: str) -> str:
    """(db_id, schema_name, editor_oid, reader_oid) → standard rights by whole schema."""
    return f"""SELECT x.db_id, x.schema_name, f.fn AS function, CASE f.fn WHEN 'editor' THEN x.editor_oid ELSE x.reader_oid END AS role_oid, c.cls AS object_class,
 CASE WHEN c.cls='SCHEMA' THEN 'USAGE' WHEN c.cls LIKE '%SEQ%' THEN CASE f.fn WHEN 'editor' THEN 'SELECT, USAGE' ELSE 'SELECT' END ELSE CASE f.fn WHEN 'editor' THEN 'SELECT, INSERT, UPDATE, DELETE' ELSE 'SELECT' END END AS privilege,
 'GRANT '||CASE WHEN c.cls='SCHEMA' THEN 'USAGE' WHEN c.cls LIKE '%SEQ%' THEN CASE f.fn WHEN 'editor' THEN 'SELECT, USAGE' ELSE 'SELECT' END ELSE CASE f.fn WHEN 'editor' THEN 'SELECT, INSERT, UPDATE, DELETE' ELSE 'SELECT' END END
 ||' ON '||c.cls||' '||{q('x.schema_name')}||' TO '||u.ref AS command
 FROM {source} x CROSS JOIN fn f CROSS JOIN (VALUES ('SCHEMA'),('ALL TABLES IN SCHEMA'),('ALL SEQUENCES IN SCHEMA')) c(cls)
 LEFT JOIN rolenames u ON u.role_oid=CASE f.fn WHEN 'editor' THEN x.editor_oid ELSE x.reader_oid END WHERE CASE f.fn WHEN 'editor' THEN x.editor_oid ELSE x.reader_oid END IS NOT NULL"""


DEFAULTS = """dtype(t, word) AS (VALUES ('r','TABLES'),('S','SEQUENCES'),('f','ROUTINES'),('T','TYPES'),('n','SCHEMAS'))"""


def default_commands(source: str, where: str = "true", extra: str = "") -> str:
    """REVOKE rows of default privileges, with what the admin role can reach."""
    head = f"'ALTER DEFAULT PRIVILEGES FOR ROLE '||g.ref||CASE WHEN d.schema_oid=0 THEN '' ELSE ' IN SCHEMA '||{q('n.schema_name')} END"
    return f"""SELECT DISTINCT d.db_id, d.schema_oid, n.schema_name, d.grantor_oid, d.grantee_oid, w.word AS object_class, p.privilege, {has('10', 'd.grantor_oid')} AS is_usable,
 {head}||' REVOKE '||p.privilege||' ON '||w.word||' FROM '||u.ref AS revoke_command, {head}||' GRANT '||p.privilege||' ON '||w.word||' TO ' AS grant_head{extra}
 FROM {source} d JOIN dtype w ON w.t=d.obj_type JOIN priv p ON contains(d.codes, p.code) LEFT JOIN namespaces n ON n.schema_oid=d.schema_oid
 LEFT JOIN rolenames g ON g.role_oid=d.grantor_oid LEFT JOIN rolenames u ON u.role_oid=d.grantee_oid WHERE {where}"""


TARGETS = f"""targets0 AS (SELECT t.db_id, t.schema_name, n.schema_oid,
 CASE WHEN r.is_created IS NULL THEN 'unregistered' WHEN r.is_created THEN 'created' ELSE 'not created' END AS status,
 CASE WHEN r.is_created THEN l.producer_oid ELSE n.owner_oid END AS producer_oid,
 CASE WHEN r.is_created THEN l.editor_oid WHEN r.editor='public' THEN 0 ELSE e.role_oid END AS editor_oid,
 CASE WHEN r.is_created THEN l.reader_oid WHEN r.reader='public' THEN 0 ELSE d.role_oid END AS reader_oid,
 CASE WHEN regexp_matches(t.schema_name,'^pg_toast|^pg_temp|^pg_catalog$|^public$|^information_schema$|^topology$') THEN 'FIS1' WHEN n.schema_oid IS NULL THEN 'FIS2' END AS error0, n.owner_oid
 FROM wanted_targets t LEFT JOIN namespaces n ON n.db_id=t.db_id AND n.schema_name=t.schema_name LEFT JOIN registry r ON r.db_id=t.db_id AND r.schema_name=t.schema_name
 LEFT JOIN live l ON l.db_id=t.db_id AND l.schema_name=t.schema_name LEFT JOIN roles e ON e.role_name=r.editor LEFT JOIN roles d ON d.role_name=r.reader),
targets AS (SELECT *, CASE WHEN error0 IS NOT NULL THEN error0 WHEN owner_oid IS NULL OR owner_oid NOT IN (SELECT role_oid FROM within) THEN 'FIS3'
 WHEN status='created' AND producer_oid<>owner_oid AND producer_oid NOT IN (SELECT role_oid FROM within) THEN 'FIS4' END AS error FROM targets0)"""
WITHIN = "within AS (SELECT DISTINCT role_oid FROM usage_reach WHERE member_oid=10 {more})"


def reset_rows(fixed: bool = True) -> str:
    """Rows of the reset of ``targets``: every step in one relation."""
    shape = "CAST(s.db_id AS BIGINT) AS db_id, t.schema_name, {step} AS step, s.obj_kind, CAST(s.obj_oid AS BIGINT) AS obj_oid, s.verb, s.privilege, {cls} AS object_class, CAST(s.role_oid AS BIGINT) AS role_oid, {cmd} AS command, CAST(NULL AS VARCHAR) AS error"
    joins = "JOIN kind k ON k.kind=s.obj_kind LEFT JOIN names n ON n.cls=k.cls AND n.obj_oid=s.obj_oid LEFT JOIN rolenames u ON u.role_oid=s.role_oid"
    owner = f"""SELECT {shape.format(step=2, cls='k.alt', cmd=OWNER_CMD)} FROM (SELECT o.db_id, o.schema_oid, o.obj_kind, o.obj_oid, 'OWNER' AS verb, CAST(NULL AS VARCHAR) AS privilege, t.producer_oid AS role_oid
 FROM all_objects o JOIN targets t ON t.schema_oid=o.schema_oid WHERE t.error IS NULL AND o.owner_oid<>t.producer_oid AND NOT (o.obj_kind IN ('T','d') AND o.obj_oid IN (SELECT obj_oid FROM auto_types))) s
 JOIN targets t ON t.schema_oid=s.schema_oid {joins}"""
    held = f"""SELECT {shape.format(step='s.step', cls='k.cls', cmd=CMD)} FROM (SELECT db_id, schema_oid, obj_kind, obj_oid, column_name, privilege, role_oid, CASE verb WHEN 'GRANT' THEN 'REVOKE' ELSE 'GRANT' END AS verb, step
 FROM (SELECT *, 4 AS step FROM a34 UNION ALL SELECT *, 3 FROM a5)) s JOIN targets t ON t.schema_oid=s.schema_oid AND t.error IS NULL {joins}"""
    fixed_part = f"""SELECT {shape.format(step=6, cls='k.cls', cmd=CMD)} FROM (SELECT o.db_id, o.schema_oid, o.obj_kind, o.obj_oid, CAST(NULL AS VARCHAR) AS column_name, f.role_oid, 'GRANT' AS verb,
 CASE f.codes WHEN 'U' THEN 'USAGE' ELSE 'SELECT, INSERT, UPDATE, DELETE' END AS privilege FROM all_objects o JOIN targets t ON t.schema_oid=o.schema_oid AND t.error IS NULL
 JOIN fixed_grants f ON f.schema_name=t.schema_name AND f.obj_name=o.obj_name AND f.obj_kind=o.obj_kind) s JOIN targets t ON t.schema_oid=s.schema_oid {joins}"""
    standard = f"""SELECT CAST(db_id AS BIGINT), schema_name, 5, 'N', CAST(NULL AS BIGINT), 'GRANT', privilege, object_class, CAST(role_oid AS BIGINT), command, NULL FROM ({schema_commands('(SELECT * FROM targets WHERE error IS NULL)')})"""
    defaults = f"""SELECT CAST(db_id AS BIGINT), schema_name, 7, 'N', CAST(NULL AS BIGINT), 'REVOKE', privilege, object_class, CAST(grantee_oid AS BIGINT), CASE WHEN is_usable THEN revoke_command END, CASE WHEN NOT is_usable THEN 'FIS6' END
 FROM ({default_commands('default_acl', 'd.schema_oid IN (SELECT schema_oid FROM targets WHERE error IS NULL)')})"""
    errors = "SELECT CAST(db_id AS BIGINT), schema_name, 0, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), error FROM targets WHERE error IS NOT NULL"
    register = "SELECT CAST(db_id AS BIGINT), schema_name, 1, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CASE status WHEN 'unregistered' THEN 'insert' ELSE 'update' END, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(producer_oid AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM targets WHERE error IS NULL AND status<>'created'"
    parts = [owner, held, standard, defaults, errors, register] + ([fixed_part] if fixed else [])
    return " UNION ALL ".join(parts)


MOVES = f"""placed AS (SELECT m.*, o.db_id, o.obj_kind, o.obj_name, o.owner_oid, s.producer_oid AS p, s.editor_oid AS e, s.reader_oid AS l, t.producer_oid AS np, t.editor_oid AS ne, t.reader_oid AS nl,
 CASE WHEN s.schema_oid IS NULL THEN 'FDO2' WHEN t.schema_oid IS NULL THEN 'FDO3' WHEN o.obj_oid IS NULL THEN 'FDO5'
  WHEN EXISTS (SELECT 1 FROM conflicts c WHERE c.obj_oid=m.obj_oid AND c.target_schema_oid=m.target_schema_oid AND c.error='FDO8') THEN 'FDO8' WHEN NOT {has('10', 't.producer_oid')} THEN 'FDO6' WHEN NOT {has('10', 'o.owner_oid')} THEN 'FDO7'
  ELSE (SELECT c.error FROM conflicts c WHERE c.obj_oid=m.obj_oid AND c.target_schema_oid=m.target_schema_oid ORDER BY length(c.error), c.error LIMIT 1) END AS error
 FROM object_moves m LEFT JOIN objects o ON o.obj_oid=m.obj_oid LEFT JOIN live s ON s.schema_oid=m.source_schema_oid LEFT JOIN live t ON t.schema_oid=m.target_schema_oid),
units AS (SELECT obj_oid AS moved_oid, * FROM placed WHERE error IS NULL UNION ALL
 SELECT p.obj_oid, s.obj_oid, p.source_schema_oid, p.target_schema_oid, p.variant, p.db_id, 'S', s.obj_name, s.owner_oid, p.p, p.e, p.l, p.np, p.ne, p.nl, p.error
 FROM placed p JOIN owned_sequences w ON w.table_oid=p.obj_oid JOIN objects s ON s.obj_oid=w.sequence_oid AND s.obj_kind='S' WHERE p.error IS NULL AND p.obj_kind IN ('r','p')),
rights AS (SELECT u.moved_oid, u.obj_oid, u.target_schema_oid, u.variant AS v, u.p, u.e, u.l, u.np, u.ne, u.nl, h.obj_kind AS held_kind, h.column_name, h.role_oid AS who, h.verb, CASE h.verb WHEN 'GRANT' THEN 'REVOKE' ELSE 'GRANT' END AS inv, h.privilege
 FROM units u JOIN (SELECT * FROM a34 UNION ALL SELECT * FROM a5) h ON h.obj_oid=u.obj_oid AND h.obj_kind<>'N'),
acts AS (
 SELECT *, 2 AS step, inv AS verb2, np AS to_oid FROM rights WHERE v IN (2,6) AND who=p
 UNION ALL SELECT *, 3, inv, ne FROM rights WHERE who=ne AND (e IS NULL OR NOT e=ne) AND NOT p=ne AND NOT v=4
 UNION ALL SELECT *, 4, inv, e FROM rights WHERE who=e AND NOT e=np AND (ne IS NULL OR NOT e=ne OR v NOT IN (1,3)) AND NOT v=4
 UNION ALL SELECT *, 5, verb, ne FROM rights WHERE who=e AND ne IS NOT NULL AND v IN (1,3) AND NOT e=ne
 UNION ALL SELECT *, 7, inv, nl FROM rights WHERE who=nl AND (l IS NULL OR NOT l=nl) AND NOT p=nl AND (e IS NULL OR NOT e=nl) AND NOT v=4
 UNION ALL SELECT *, 8, inv, l FROM rights WHERE who=l AND NOT l=np AND (ne IS NULL OR NOT l=ne) AND (nl IS NULL OR NOT l=nl OR v NOT IN (1,3)) AND NOT v=4
 UNION ALL SELECT *, 9, verb, nl FROM rights WHERE who=l AND nl IS NOT NULL AND v IN (1,3) AND NOT l=nl
 UNION ALL SELECT *, 11, inv, who FROM rights WHERE v IN (2,3,5) AND who<>p AND who<>np AND (e IS NULL OR who<>e) AND (l IS NULL OR who<>l) AND (ne IS NULL OR who<>ne) AND (nl IS NULL OR who<>nl)),
moverows AS (
 SELECT moved_oid, obj_oid, held_kind AS obj_kind, column_name, target_schema_oid, step, verb2 AS verb, privilege, to_oid AS role_oid FROM acts
 UNION ALL SELECT moved_oid, obj_oid, obj_kind, NULL, target_schema_oid, 1, 'OWNER', NULL, np FROM units WHERE owner_oid<>np
 UNION ALL SELECT moved_oid, obj_oid, obj_kind, NULL, target_schema_oid, 6, 'GRANT', CASE WHEN obj_kind='S' THEN 'SELECT, USAGE' ELSE 'SELECT, INSERT, UPDATE, DELETE' END, ne FROM units WHERE obj_kind IN ('r','p','v','m','f','S') AND ne IS NOT NULL AND (variant IN (2,5,6) OR e IS NULL) AND NOT variant=4
 UNION ALL SELECT moved_oid, obj_oid, obj_kind, NULL, target_schema_oid, 10, 'GRANT', 'SELECT', nl FROM units WHERE obj_kind IN ('r','p','v','m','f','S') AND nl IS NOT NULL AND (variant IN (2,5,6) OR l IS NULL) AND NOT variant=4)"""

CONFLICTS = """taken AS (SELECT CASE WHEN obj_kind='X' THEN 'proc' WHEN obj_kind IN ('T','d') THEN 'type' ELSE 'class' END AS cat, schema_oid, obj_name AS name FROM objects
 UNION ALL SELECT 'class', schema_oid, index_name FROM table_indexes),
asked AS (SELECT m.obj_oid, m.target_schema_oid, 'FDO8' AS error, CASE WHEN o.obj_kind='X' THEN 'proc' WHEN o.obj_kind IN ('T','d') THEN 'type' ELSE 'class' END AS cat, o.obj_name AS name FROM object_moves m JOIN objects o ON o.obj_oid=m.obj_oid
 UNION ALL SELECT m.obj_oid, m.target_schema_oid, CASE WHEN i.is_constraint THEN 'FDO9' ELSE 'FDO10' END, 'class', i.index_name FROM object_moves m JOIN objects o ON o.obj_oid=m.obj_oid AND o.obj_kind IN ('r','p') JOIN table_indexes i ON i.table_oid=m.obj_oid
 UNION ALL SELECT m.obj_oid, m.target_schema_oid, 'FDO11', 'class', s.obj_name FROM object_moves m JOIN objects o ON o.obj_oid=m.obj_oid AND o.obj_kind IN ('r','p') JOIN owned_sequences w ON w.table_oid=m.obj_oid JOIN objects s ON s.obj_oid=w.sequence_oid),
conflicts AS (SELECT DISTINCT a.obj_oid, a.target_schema_oid, a.error, a.name FROM asked a JOIN taken t ON t.cat=a.cat AND t.schema_oid=a.target_schema_oid AND t.name=a.name)"""


def plans() -> dict[str, str]:
    graph = f"{USAGE},\n{SUPERS}"
    own = """owning AS (SELECT o.db_id, a.schema_name, a.obj_kind, a.obj_oid, 'OWNER' AS verb, CAST(NULL AS VARCHAR) AS privilege, CAST(NULL AS VARCHAR) AS column_name, a.producer_oid AS role_oid, k.base AS is_base
 FROM audited a JOIN all_objects o ON o.obj_kind=a.obj_kind AND o.obj_oid=a.obj_oid JOIN kind k ON k.kind=a.obj_kind WHERE a.owner_oid<>a.producer_oid AND NOT (a.obj_kind IN ('T','d') AND a.obj_oid IN (SELECT obj_oid FROM auto_types)))"""
    std = f"""std AS (SELECT o.db_id, x.obj_kind, x.obj_oid, CAST(NULL AS VARCHAR) AS column_name, 'GRANT' AS verb, {STANDARD_LIST} AS privilege, CASE f.fn WHEN 'editor' THEN x.editor_oid ELSE x.reader_oid END AS role_oid, f.fn AS function
 FROM audited x JOIN all_objects o ON o.obj_kind=x.obj_kind AND o.obj_oid=x.obj_oid CROSS JOIN fn f WHERE x.obj_kind IN ('N','S','r','p','v','m','f') AND CASE f.fn WHEN 'editor' THEN x.editor_oid ELSE x.reader_oid END IS NOT NULL)"""
    rows = {}
    rows["ownership_plan"] = with_inputs(
        commands("owning", f"{big('db_id', 'obj_oid', 'role_oid')}, s.schema_name, s.obj_kind, s.is_base"), f"{PLAN},\n{AUDITED},\n{own}")
    rows["ownership_counts"] = with_inputs(
        "SELECT CAST(db_id AS BIGINT) AS db_id, schema_name, CAST(count(*) AS BIGINT) AS changes FROM owning GROUP BY ALL", f"{KIND},\n{AUDITED},\n{own}")
    rows["standard_grants"] = with_inputs(
        commands("std", f"{big('db_id', 'obj_oid', 'role_oid')}, s.obj_kind, s.privilege, s.function"), f"{PLAN},\n{AUDITED},\n{FN},\n{std}")
    rows["schema_grants"] = with_inputs(
        f"SELECT CAST(db_id AS BIGINT) AS db_id, schema_name, function, CAST(role_oid AS BIGINT) AS role_oid, privilege, object_class, command FROM ({schema_commands('live')})", f"{PLAN},\n{LIVE},\n{FN}")
    rows["reset_schema_plan"] = with_inputs(
        reset_rows(), f"{PLAN},\n{LIVE},\n{FN},\n{graph},\n{DEFAULTS},\nwanted_targets AS (SELECT * FROM reset_targets),\n{WITHIN.format(more='')},\n{TARGETS}", recursive=True)
    reset_obj = """asked AS (SELECT obj_oid, obj_type, CASE WHEN obj_type IN ('table','view','materialized view','foreign table','partitioned table') THEN 'TABLE'
 WHEN obj_type='sequence' THEN 'SEQUENCE' WHEN obj_type IN ('function','aggregate','procedure','routine') THEN 'ROUTINE' WHEN obj_type IN ('type','domain') THEN 'TYPE' END AS cls FROM object_reset_requests),
things AS (SELECT a.obj_oid, a.cls, o.obj_kind, o.db_id, o.schema_oid, o.owner_oid, l.producer_oid, l.editor_oid, l.reader_oid,
 CASE WHEN o.obj_kind IS NOT NULL AND l.schema_oid IS NULL THEN 'FIO2' WHEN a.cls IS NULL THEN 'FIO3' WHEN o.obj_kind IS NULL OR k.cls<>a.cls THEN 'FIO4' WHEN NOT {HASP} THEN 'FIO5' WHEN o.owner_oid<>l.producer_oid AND NOT {HASO} THEN 'FIO6' END AS error
 FROM asked a LEFT JOIN objects o ON o.obj_oid=a.obj_oid LEFT JOIN kind k ON k.kind=o.obj_kind LEFT JOIN live l ON l.schema_oid=o.schema_oid),
steps AS (SELECT DISTINCT * FROM (
 SELECT obj_oid, obj_kind, CAST(NULL AS VARCHAR) AS column_name, 2 AS step, 'OWNER' AS verb, CAST(NULL AS VARCHAR) AS privilege, producer_oid AS role_oid FROM things WHERE error IS NULL AND owner_oid<>producer_oid
 UNION ALL SELECT h.obj_oid, h.obj_kind, h.column_name, CASE WHEN h.role_oid=0 THEN 3 ELSE 4 END, CASE h.verb WHEN 'GRANT' THEN 'REVOKE' ELSE 'GRANT' END, h.privilege, h.role_oid
  FROM (SELECT * FROM a34 UNION ALL SELECT * FROM a5) h JOIN things t ON t.obj_oid=h.obj_oid AND t.error IS NULL AND h.obj_kind<>'N'
 UNION ALL SELECT obj_oid, obj_kind, NULL, 5, 'GRANT', CASE WHEN obj_kind='S' THEN 'SELECT, USAGE' ELSE 'SELECT, INSERT, UPDATE, DELETE' END, editor_oid FROM things WHERE error IS NULL AND obj_kind IN ('r','p','v','m','f','S') AND editor_oid IS NOT NULL
 UNION ALL SELECT obj_oid, obj_kind, NULL, 5, 'GRANT', 'SELECT', reader_oid FROM things WHERE error IS NULL AND obj_kind IN ('r','p','v','m','f','S') AND reader_oid IS NOT NULL))"""
    rows["reset_object_plan"] = with_inputs(
        commands("steps", f"{big('obj_oid', 'role_oid')}, s.step, s.verb, s.privilege, CAST(NULL AS VARCHAR) AS error, CASE WHEN s.verb='OWNER' THEN k.alt ELSE k.cls END AS object_class")
        + " UNION ALL SELECT DISTINCT CAST(obj_oid AS BIGINT), NULL, 0, NULL, NULL, error, NULL, NULL FROM things WHERE error IS NOT NULL",
        f"{PLAN},\n{LIVE},\n{graph},\n"
        + reset_obj.replace("{HASP}", has("10", "l.producer_oid")).replace("{HASO}", has("10", "o.owner_oid")), recursive=True)
    rows["move_conflicts"] = with_inputs(f"SELECT {big('obj_oid', 'target_schema_oid')}, error, name FROM conflicts s", CONFLICTS)
    later = f"CASE WHEN o.obj_kind='X' THEN {q('z.schema_name')}||'.'||{q('o.obj_name')}||'()' ELSE {q('z.schema_name')}||'.'||{q('o.obj_name')} END"
    rows["move_object_plan"] = with_inputs(
        f"""SELECT {big('moved_oid', 'obj_oid', 'role_oid')}, s.step, s.verb, s.privilege, CAST(NULL AS VARCHAR) AS error,
 CASE WHEN s.verb='OWNER' THEN 'ALTER '||k.alt||' '||{later}||' OWNER TO '||u.ref ELSE s.verb||' '||s.privilege||CASE WHEN s.column_name IS NULL THEN '' ELSE ' ('||{q('s.column_name')}||')' END||' ON '||k.cls||' '||{later}||CASE s.verb WHEN 'GRANT' THEN ' TO ' ELSE ' FROM ' END||u.ref END AS command
 FROM moverows s JOIN kind k ON k.kind=s.obj_kind JOIN objects o ON o.obj_oid=s.obj_oid JOIN namespaces z ON z.schema_oid=s.target_schema_oid LEFT JOIN rolenames u ON u.role_oid=s.role_oid
 UNION ALL SELECT CAST(m.obj_oid AS BIGINT), CAST(m.obj_oid AS BIGINT), NULL, 0, 'SET SCHEMA', NULL, NULL, 'ALTER '||k.alt||' '||n.target||' SET SCHEMA '||{q('z.schema_name')} FROM placed m JOIN kind k ON k.kind=m.obj_kind JOIN names n ON n.cls=k.cls AND n.obj_oid=m.obj_oid JOIN namespaces z ON z.schema_oid=m.target_schema_oid WHERE m.error IS NULL
 UNION ALL SELECT CAST(obj_oid AS BIGINT), CAST(obj_oid AS BIGINT), NULL, -1, NULL, NULL, error, NULL FROM placed WHERE error IS NOT NULL""",
        f"{PLAN},\n{LIVE},\n{graph},\n{CONFLICTS},\n{MOVES}", recursive=True)
    blocked = f"""blocked AS (SELECT r.db_id, r.schema_name, r.producer, p.role_oid AS producer_oid, CASE WHEN p.role_oid IS NULL THEN 'unknown producer' WHEN p.is_super THEN 'super' WHEN p.can_login THEN 'login' ELSE 'grant' END AS reason
 FROM registry r LEFT JOIN roles p ON p.role_name=r.producer WHERE r.is_created AND NOT {has('10', 'p.role_oid')}),
wanted_targets AS (SELECT db_id, schema_name FROM registry r WHERE is_created AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.reason<>'grant' AND b.db_id=r.db_id AND b.schema_name=r.schema_name))"""
    none = "CAST(NULL AS VARCHAR)"
    rows["reset_all_plan"] = with_inputs(
        f"""SELECT *, CAST(2 AS INTEGER) AS rank FROM (SELECT * FROM ({reset_rows()}) WHERE error IS DISTINCT FROM 'FIS2'
 UNION ALL SELECT CAST(db_id AS BIGINT), schema_name, 0, {none}, CAST(NULL AS BIGINT), {none}, reason, {none}, CAST(NULL AS BIGINT), {none}, 'FAS0' FROM blocked WHERE reason<>'grant'
 UNION ALL SELECT CAST(db_id AS BIGINT), schema_name, 0, {none}, CAST(NULL AS BIGINT), {none}, 'missing schema', {none}, CAST(NULL AS BIGINT), {none}, 'FAS0' FROM targets WHERE error='FIS2'
 UNION ALL SELECT CAST(db_id AS BIGINT), schema_name, 0, {none}, CAST(NULL AS BIGINT), 'GRANT', {none}, {none}, CAST(NULL AS BIGINT), 'GRANT '||{q('producer')}||' TO g_admin', {none} FROM blocked WHERE reason='grant')""",
        f"{PLAN},\n{LIVE},\n{FN},\n{graph},\n{DEFAULTS},\n{blocked},\n{WITHIN.format(more="OR member_oid IN (SELECT producer_oid FROM blocked WHERE reason='grant')")},\n{TARGETS}", recursive=True)
    rows["default_acl_plan"] = with_inputs(
        f"""SELECT {big('db_id', 'schema_oid', 'grantor_oid', 'grantee_oid')}, object_class, privilege, is_usable, 'REVOKE' AS verb, CAST(grantee_oid AS BIGINT) AS role_oid, CASE WHEN is_usable THEN revoke_command END AS command, CASE WHEN NOT is_usable THEN 'FIS6' END AS error
 FROM ({default_commands('default_acl')}) s""", f"{PLAN},\n{graph},\n{DEFAULTS}", recursive=True)
    rows["outer_object_grants"] = with_inputs(
        f"""SELECT DISTINCT o.obj_class, o.obj_name, CAST(o.grantee_oid AS BIGINT) AS role_oid, p.privilege, 'GRANT '||p.privilege||' ON '||o.obj_class||' '||{q('o.obj_name')}||' TO '||u.ref AS command
 FROM outer_acl o JOIN priv p ON contains(o.codes, p.code) LEFT JOIN rolenames u ON u.role_oid=o.grantee_oid WHERE o.grantee_oid<>0""", PLAN)
    switch = f"""held AS (SELECT h.*, w.schema_name, w.function, w.new_oid FROM (SELECT * FROM a34 UNION ALL SELECT * FROM a5) h JOIN function_switches w ON w.schema_oid=h.schema_oid AND w.old_oid=h.role_oid),
switched AS (SELECT db_id, schema_oid, schema_name, function, 'copy' AS action, obj_kind, obj_oid, column_name, verb, privilege, new_oid AS role_oid FROM held WHERE new_oid IS NOT NULL
 UNION ALL SELECT db_id, schema_oid, schema_name, function, 'remove', obj_kind, obj_oid, column_name, 'REVOKE', privilege, role_oid FROM held WHERE verb='GRANT'),
bare AS (SELECT w.*, CASE WHEN function='editor' THEN new_oid END AS editor_oid, CASE WHEN function='reader' THEN new_oid END AS reader_oid FROM function_switches w WHERE new_oid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.schema_oid=w.schema_oid AND h.function=w.function))"""
    rows["function_switch_plan"] = with_inputs(
        commands("switched", f"{big('db_id', 'role_oid')}, s.schema_name, s.function, s.action, s.verb, s.privilege, k.cls AS object_class")
        + f" UNION ALL SELECT CAST(db_id AS BIGINT), CAST(role_oid AS BIGINT), schema_name, function, 'standard', 'GRANT', privilege, object_class, command FROM ({schema_commands('bare')})",
        f"{PLAN},\n{FN},\n{switch}")
    rows["rename_owner_plan"] = with_inputs(
        f"""SELECT {big('db_id', 'schema_oid', of='r')}, r.schema_name, 'rename' AS action, 'ALTER SCHEMA '||{q('n.schema_name')}||' RENAME TO '||{q('r.schema_name')} AS command FROM registry r JOIN namespaces n ON n.schema_oid=r.schema_oid WHERE r.is_created AND n.schema_name<>r.schema_name
 UNION ALL SELECT CAST(r.db_id AS BIGINT), CAST(r.schema_oid AS BIGINT), r.schema_name, CASE WHEN n.owner_oid=r.producer_oid THEN 'objects' ELSE 'schema and objects' END, CASE WHEN n.owner_oid<>r.producer_oid THEN 'ALTER SCHEMA '||{q('r.schema_name')}||' OWNER TO '||{q('p.role_name')} END
 FROM registry r JOIN namespaces n ON n.schema_oid=r.schema_oid LEFT JOIN roles p ON p.role_oid=r.producer_oid WHERE r.is_created AND (n.owner_oid<>r.producer_oid OR EXISTS (SELECT 1 FROM objects o WHERE o.schema_oid=r.schema_oid))""")
    target = f"CASE WHEN s.obj_kind='N' THEN {q('n.schema_name')} ELSE {q('n.schema_name')}||'.'||{q('s.obj_name')}||CASE WHEN s.obj_kind='X' THEN '()' ELSE '' END END"
    rows["reassign_owned_plan"] = with_inputs(
        f"""SELECT {big('db_id', 'obj_oid')}, CAST(coalesce(x.target_oid, 10) AS BIGINT) AS role_oid, CAST(s.owner_oid AS BIGINT) AS old_owner_oid, s.obj_kind, 'ALTER '||k.alt||' '||{target}||' OWNER TO '||{q('u.role_name')} AS command
 FROM all_objects s JOIN role_replacements x ON x.role_oid=s.owner_oid JOIN kind k ON k.kind=s.obj_kind LEFT JOIN namespaces n ON n.schema_oid=s.schema_oid LEFT JOIN roles u ON u.role_oid=coalesce(x.target_oid, 10)""", KIND)
    fn = """pairs AS (SELECT x.role_oid, x.target_oid, a.role_name AS x, b.role_name AS y, coalesce(b.role_name,'g_admin') AS heir FROM role_replacements x JOIN roles a ON a.role_oid=x.role_oid LEFT JOIN roles b ON b.role_oid=x.target_oid),
f0 AS (SELECT p.*, r.db_id, r.schema_name, r.producer AS pr, r.editor AS ed, r.reader AS re FROM registry r JOIN pairs p ON p.x=r.producer OR p.x=r.editor OR p.x=r.reader),
f1 AS (SELECT role_oid, target_oid, x, y, heir, db_id, schema_name, pr, ed, re, CASE WHEN pr=x THEN coalesce(y,'g_admin') ELSE pr END AS p1, CASE WHEN pr=x AND ed=heir THEN NULL ELSE ed END AS e1, CASE WHEN pr=x AND re=heir THEN NULL ELSE re END AS l1 FROM f0),
f2 AS (SELECT *, CASE WHEN e1=x THEN CASE WHEN p1=y THEN NULL ELSE y END ELSE e1 END AS e2, CASE WHEN e1=x AND (p1=y) IS NOT TRUE AND l1=y THEN NULL ELSE l1 END AS l2 FROM f1),
f3 AS (SELECT *, CASE WHEN l2=x THEN CASE WHEN p1=y OR e2=y THEN NULL ELSE y END ELSE l2 END AS l3 FROM f2)"""
    rows["reassigned_functions"] = with_inputs(
        "SELECT CAST(role_oid AS BIGINT) AS replaced_oid, CAST(target_oid AS BIGINT) AS target_oid, CAST(db_id AS BIGINT) AS db_id, schema_name, pr AS producer, ed AS editor, re AS reader, p1 AS new_producer, e2 AS new_editor, l3 AS new_reader FROM f3", fn)
    n = "CAST(NULL AS {})".format
    residual = """resid AS (SELECT h.*, x.role_oid AS replaced_oid, x.target_oid FROM a34 h JOIN role_replacements x ON x.role_oid=h.role_oid),
resid2 AS (SELECT db_id, schema_oid, obj_kind, obj_oid, column_name, privilege, replaced_oid, target_oid, CASE verb WHEN 'GRANT' THEN 'REVOKE' ELSE 'GRANT' END AS verb, role_oid FROM resid
 UNION ALL SELECT db_id, schema_oid, obj_kind, obj_oid, column_name, privilege, replaced_oid, target_oid, verb, target_oid FROM resid WHERE target_oid IS NOT NULL),
owned AS (SELECT o.db_id, o.schema_oid, o.obj_kind, o.obj_oid, 'OWNER' AS verb, CAST(NULL AS VARCHAR) AS privilege, CAST(NULL AS VARCHAR) AS column_name, coalesce(x.target_oid, 10) AS role_oid, o.owner_oid AS replaced_oid FROM all_objects o JOIN role_replacements x ON x.role_oid=o.owner_oid),
outr AS (SELECT DISTINCT o.obj_class, o.obj_name, p.privilege, x.role_oid, x.target_oid FROM outer_acl o JOIN priv p ON contains(o.codes, p.code) JOIN role_replacements x ON x.role_oid=o.grantee_oid)"""
    rows["reassign_role_plan"] = with_inputs(
        f"""SELECT CAST(role_oid AS BIGINT) AS replaced_oid, CAST(target_oid AS BIGINT) AS target_oid, 'functions' AS step, CAST(db_id AS BIGINT) AS db_id, {n('BIGINT')} AS schema_oid, {n('VARCHAR')} AS obj_kind, {n('BIGINT')} AS obj_oid, {n('VARCHAR')} AS verb, {n('VARCHAR')} AS privilege,
 schema_name||' | '||coalesce(p1,'-')||' | '||coalesce(e2,'-')||' | '||coalesce(l3,'-') AS command, {n('VARCHAR')} AS error FROM f3
 UNION ALL {commands('owned', f"CAST(s.replaced_oid AS BIGINT), CAST(s.role_oid AS BIGINT), 'owned', CAST(s.db_id AS BIGINT), CAST(s.schema_oid AS BIGINT), s.obj_kind, CAST(s.obj_oid AS BIGINT), s.verb, s.privilege").replace(' AS command FROM owned', ' AS command, NULL FROM owned')}
 UNION ALL {commands('resid2', f"CAST(s.replaced_oid AS BIGINT), CAST(s.target_oid AS BIGINT), 'grants', CAST(s.db_id AS BIGINT), CAST(s.schema_oid AS BIGINT), s.obj_kind, CAST(s.obj_oid AS BIGINT), s.verb, s.privilege").replace(' AS command FROM resid2', ' AS command, NULL FROM resid2')}
 UNION ALL SELECT CAST(d.grantee_oid AS BIGINT), CAST(d.target_oid AS BIGINT), 'default_acl', CAST(d.db_id AS BIGINT), CAST(d.schema_oid AS BIGINT), NULL, NULL, t.verb, d.privilege, CASE WHEN is_usable THEN CASE t.verb WHEN 'REVOKE' THEN revoke_command ELSE grant_head||v.ref END END, CASE WHEN NOT is_usable THEN 'FRR3' END
  FROM (SELECT z.*, x.target_oid FROM ({default_commands('default_acl')}) z JOIN role_replacements x ON x.role_oid=z.grantee_oid) d CROSS JOIN (VALUES ('REVOKE'),('GRANT')) t(verb) LEFT JOIN rolenames v ON v.role_oid=d.target_oid WHERE t.verb='REVOKE' OR d.target_oid IS NOT NULL
 UNION ALL SELECT CAST(o.role_oid AS BIGINT), CAST(o.target_oid AS BIGINT), 'outer', NULL, NULL, NULL, NULL, t.verb, o.privilege, t.verb||' '||o.privilege||' ON '||o.obj_class||' '||{q('o.obj_name')}||CASE t.verb WHEN 'GRANT' THEN ' TO ' ELSE ' FROM ' END||u.ref, NULL
  FROM outr o CROSS JOIN (VALUES ('REVOKE'),('GRANT')) t(verb) LEFT JOIN rolenames u ON u.role_oid=CASE t.verb WHEN 'GRANT' THEN o.target_oid ELSE o.role_oid END WHERE t.verb='REVOKE' OR o.target_oid IS NOT NULL""",
        f"{PLAN},\n{graph},\n{DEFAULTS},\n{fn},\n{residual}", recursive=True)
    return rows


REVIEW = """c0 AS (SELECT c.*, CASE WHEN c.op='UPDATE' AND r.schema_name IS NULL THEN 'INSERT' ELSE c.op END AS op2, r.schema_name AS rn, r.block AS rb, r.in_nomenclature AS rt, r.is_created AS rc, r.schema_oid AS ro,
  r.producer AS rp, r.producer_oid AS rpo, r.editor AS re, r.editor_oid AS reo, r.reader AS rl, r.reader_oid AS rlo FROM (SELECT *, max(change_id) OVER (PARTITION BY db_id, target_schema_name) AS newest FROM change_sets) c LEFT JOIN registry r ON r.db_id=c.db_id AND r.schema_name=c.target_schema_name WHERE c.change_id=c.newest),
c1 AS (SELECT change_id, db_id, op2 AS op, actor_oid, new_schema_name AS raw_name, new_block AS raw_block, nullif(new_schema_name,'') AS name, nullif(new_block,'') AS block, coalesce(nullif(new_producer,''),'g_admin') AS p,
  nullif(new_editor,'') AS e, nullif(new_reader,'') AS l, coalesce(new_created,false) AS cr, coalesce(new_nomenclature,false) AS nom,
  CASE WHEN op2<>'INSERT' THEN rn END AS old_name, CASE WHEN op2<>'INSERT' THEN rb END AS old_block, CASE WHEN op2<>'INSERT' THEN rt END AS old_nom, CASE WHEN op2<>'INSERT' THEN rc END AS old_cr, CASE WHEN op2<>'INSERT' THEN ro END AS old_oid,
  CASE WHEN op2<>'INSERT' THEN rp END AS old_p, CASE WHEN op2<>'INSERT' THEN rpo END AS old_po, CASE WHEN op2<>'INSERT' THEN re END AS old_e, CASE WHEN op2<>'INSERT' THEN reo END AS old_eo, CASE WHEN op2<>'INSERT' THEN rl END AS old_l, CASE WHEN op2<>'INSERT' THEN rlo END AS old_lo FROM c0),
c2 AS (SELECT c.*, CASE WHEN cr AND op<>'INSERT' THEN old_oid END AS soid, op='UPDATE' AND cr AND coalesce(old_cr,false) AS lasting FROM c1 c),
c3 AS (SELECT c.* EXCLUDE (p, e, l), (c.lasting AND c.p=c.old_p AND (np.role_oid IS NULL OR np.role_name<>c.p)) IS TRUE AS clean_p, (c.lasting AND c.e=c.old_e AND c.e<>'public' AND (ne.role_oid IS NULL OR ne.role_name<>c.e)) IS TRUE AS clean_e,
  (c.lasting AND c.l=c.old_l AND c.l<>'public' AND (nl.role_oid IS NULL OR nl.role_name<>c.l)) IS TRUE AS clean_l,
  CASE WHEN c.lasting AND c.p=c.old_p THEN CASE WHEN np.role_oid IS NULL THEN w.role_name ELSE np.role_name END ELSE c.p END AS p,
  CASE WHEN c.lasting AND c.e=c.old_e AND c.e<>'public' THEN ne.role_name ELSE c.e END AS e, CASE WHEN c.lasting AND c.l=c.old_l AND c.l<>'public' THEN nl.role_name ELSE c.l END AS l,
  CASE WHEN cr AND op<>'INSERT' THEN CASE WHEN c.lasting AND c.p=c.old_p AND np.role_oid IS NULL THEN n.owner_oid ELSE old_po END END AS po,
  CASE WHEN cr AND op<>'INSERT' AND c.e IS NOT NULL THEN CASE WHEN c.lasting AND c.e=c.old_e AND c.e<>'public' AND ne.role_oid IS NULL THEN NULL ELSE old_eo END END AS eo,
  CASE WHEN cr AND op<>'INSERT' AND c.l IS NOT NULL THEN CASE WHEN c.lasting AND c.l=c.old_l AND c.l<>'public' AND nl.role_oid IS NULL THEN NULL ELSE old_lo END END AS lo
  FROM c2 c LEFT JOIN roles np ON np.role_oid=c.old_po LEFT JOIN roles ne ON ne.role_oid=c.old_eo LEFT JOIN roles nl ON nl.role_oid=c.old_lo LEFT JOIN namespaces n ON n.schema_oid=c.soid LEFT JOIN roles w ON w.role_oid=n.owner_oid)"""

ALIGN = """t1 AS (SELECT *, CASE WHEN NOT regexp_matches(name,'^d_') OR op='DELETE' THEN NULL
  WHEN op='INSERT' THEN CASE WHEN block IS NULL OR block='d' THEN substr(name,3) END
  WHEN block='d' AND NOT old_block='d' THEN old_block||'_'||substr(name,3) WHEN block IS NULL AND NOT old_block='d' THEN old_block||'_'||substr(name,3)
  WHEN block='d' AND old_block='d' AND regexp_matches(old_name,'^[a-ce-z]_') THEN regexp_extract(old_name,'^([a-ce-z]_)',1)||substr(name,3)
  WHEN block='d' AND old_block='d' AND NOT regexp_matches(old_name,'^[a-z]_') THEN substr(name,3)
  WHEN block IS NULL AND old_block IS NULL THEN substr(name,3) WHEN block='d' AND old_block IS NULL THEN substr(name,3)
  WHEN block=old_block AND NOT block='d' THEN old_block||'_'||substr(name,3) END AS tn FROM c3),
t2 AS (SELECT * EXCLUDE (name, block, tn), coalesce(tn, name) AS n, CASE WHEN tn IS NOT NULL THEN 'd' ELSE block END AS b FROM t1),
t3 AS (SELECT *, CASE WHEN op='DELETE' THEN 'keep' WHEN b IS NULL AND regexp_matches(n,'^[a-z]_') THEN CASE WHEN op='UPDATE' AND old_block IS NOT NULL AND regexp_matches(old_name,'^[a-z]_') AND left(n,1)=left(old_name,1) THEN 'strip' ELSE 'take' END
  WHEN b IS NULL THEN 'keep'
  WHEN NOT starts_with(n, b||'_') AND NOT b='d' THEN
   CASE WHEN regexp_matches(n,'^([a-z])?_') THEN CASE WHEN op='UPDATE' AND NOT n=old_name AND b=old_block THEN 'take' WHEN NOT regexp_matches(b,'^[a-z]$') THEN CASE op WHEN 'UPDATE' THEN 'TB14' ELSE 'TB15' END ELSE 'swap' END
   WHEN NOT regexp_matches(b,'^[a-z]$') THEN 'TB16' WHEN op='UPDATE' AND b=old_block AND regexp_matches(old_name,'^([a-z])?_') THEN 'unset' ELSE 'add' END ELSE 'keep' END AS act FROM t2),
aligned AS (SELECT * EXCLUDE (n, b, act), CASE act WHEN 'strip' THEN regexp_replace(n,'^[a-z]_','') WHEN 'swap' THEN b||'_'||regexp_replace(n,'^([a-z])?_','') WHEN 'add' THEN b||'_'||n ELSE n END AS name,
  CASE act WHEN 'strip' THEN NULL WHEN 'unset' THEN NULL WHEN 'take' THEN nullif(regexp_extract(n,'^([a-z])_',1),'') ELSE b END AS block, CASE WHEN act LIKE 'TB%' THEN act END AS align_code FROM t3)"""

FACTS = f"""facts AS (SELECT a.*, CASE WHEN a.cr THEN CASE WHEN a.p='public' THEN 0 ELSE fp.role_oid END END AS fpo, CASE WHEN a.cr THEN CASE WHEN a.e='public' THEN 0 ELSE fe.role_oid END END AS feo, CASE WHEN a.cr THEN CASE WHEN a.l='public' THEN 0 ELSE fl.role_oid END END AS flo,
  coalesce(fp.is_super,false) AS sup_p, coalesce(op.is_super,false) AS sup_op, {has('a.actor_oid', 'fp.role_oid')} AS has_p, {has('a.actor_oid', 'op.role_oid')} AS has_op, {has('a.actor_oid', 'a.old_po')} AS has_owner,
  {has('a.actor_oid', '10', 'member_reach')} AS is_admin, (a.db_id, a.actor_oid) IN (SELECT (d.db_id, u.member_oid) FROM database_creators d JOIN usage_reach u ON u.role_oid=d.role_oid) OR a.actor_oid IN (SELECT role_oid FROM supers) AS may_create,
  EXISTS (SELECT 1 FROM namespaces n WHERE n.db_id=a.db_id AND n.schema_name=a.name) AS there, EXISTS (SELECT 1 FROM namespaces n WHERE n.db_id=a.db_id AND n.schema_name=a.raw_name) AS raw_there, EXISTS (SELECT 1 FROM namespaces n WHERE n.db_id=a.db_id AND n.schema_name=a.old_name) AS old_there,
  EXISTS (SELECT 1 FROM registry r WHERE r.db_id=a.db_id AND r.schema_name=a.name) AS listed
  FROM aligned a LEFT JOIN roles fp ON fp.role_name=a.p LEFT JOIN roles fe ON fe.role_name=a.e LEFT JOIN roles fl ON fl.role_name=a.l LEFT JOIN roles op ON op.role_name=a.old_p),
codes AS (SELECT change_id, op, name, code FROM (
  SELECT *, 'NO_ROW' AS code FROM facts WHERE op='DELETE' AND old_name IS NULL
  UNION ALL SELECT *, 'TB1' FROM facts WHERE op='INSERT' AND NOT may_create
  UNION ALL SELECT *, 'TB2' FROM facts WHERE op='DELETE' AND old_cr
  UNION ALL SELECT *, 'TB3' FROM facts WHERE op='DELETE' AND old_nom
  UNION ALL SELECT *, 'TB23' FROM facts WHERE op='UPDATE' AND old_block='d' AND old_cr AND NOT cr AND old_there AND NOT has_owner
  UNION ALL SELECT *, 'TB4' FROM facts WHERE op='UPDATE' AND old_cr AND NOT cr AND NOT (coalesce(old_block='d',false) AND old_there) AND raw_there
  UNION ALL SELECT *, 'TB18' FROM facts WHERE op='UPDATE' AND (old_nom OR nom) AND NOT is_admin AND (coalesce(old_nom,false)<>nom OR coalesce(old_name,'')<>coalesce(raw_name,'') OR coalesce(old_block,'')<>coalesce(raw_block,''))
  UNION ALL SELECT *, 'TB19' FROM facts WHERE op='INSERT' AND nom AND NOT is_admin
  UNION ALL SELECT *, 'TB8' FROM facts WHERE op<>'DELETE' AND name IS NULL
  UNION ALL SELECT *, 'TB13' FROM facts WHERE op<>'DELETE' AND (flo=fpo OR feo=fpo OR flo=feo)
  UNION ALL SELECT *, align_code FROM facts WHERE align_code IS NOT NULL
  UNION ALL SELECT *, 'TB9' FROM facts WHERE op='INSERT' AND listed
  UNION ALL SELECT *, 'TB10' FROM facts WHERE op='UPDATE' AND NOT name=old_name AND listed
  UNION ALL SELECT *, 'TB20' FROM facts WHERE op='UPDATE' AND old_cr AND sup_op AND NOT has_op AND (NOT old_name=name OR NOT old_p=p AND NOT clean_p OR coalesce(old_e,'')<>coalesce(e,'') AND NOT clean_e OR coalesce(old_l,'')<>coalesce(l,'') AND NOT clean_l)
  UNION ALL SELECT *, 'TB21' FROM facts WHERE op='UPDATE' AND cr AND NOT old_cr AND sup_p AND NOT has_p
  UNION ALL SELECT *, 'TB24' FROM facts WHERE op='UPDATE' AND cr AND sup_p AND NOT old_p=p AND NOT clean_p AND NOT has_p
  UNION ALL SELECT *, 'TB22' FROM facts WHERE op='INSERT' AND cr AND sup_p AND NOT there AND NOT has_p
  UNION ALL SELECT *, 'TB25' FROM facts WHERE op='INSERT' AND sup_p AND there AND NOT has_p)),
ok0 AS (SELECT f.* FROM facts f WHERE NOT EXISTS (SELECT 1 FROM codes c WHERE c.change_id=f.change_id) AND NOT (op='UPDATE' AND coalesce(old_block='d',false) AND old_cr AND NOT cr AND old_there)),
ok AS (SELECT * FROM ok0 o WHERE op='DELETE' OR change_id=(SELECT min(x.change_id) FROM ok0 x WHERE x.op<>'DELETE' AND x.db_id=o.db_id AND x.name=o.name))"""


def registry() -> dict[str, str]:
    full = f"{USAGE},\n{MEMBER},\n{SUPERS},\n{REVIEW},\n{ALIGN},\n{FACTS}"
    codes = "SELECT CAST(change_id AS BIGINT) AS change_id, op, name AS schema_name, code FROM codes"
    checks = {
        "role_repetition": "('TB13')",
        "deletion_rules": "('NO_ROW','TB2','TB3','TB26','TB4','TB23')",
        "taxonomy_lock": "('TB1','TB18','TB19')",
        "superuser_rules": "('TB20','TB21','TB22','TB24','TB25')",
        "missing_name": "('TB8')",
        "name_conflicts": "('TB9','TB10','TB11','TB12')",
    }
    out = {name: with_inputs(f"{codes} WHERE code IN {c}", full, recursive=True) for name, c in checks.items()}
    ids = "CAST(change_id AS BIGINT) AS change_id"
    out["validate_changes"] = with_inputs(codes, full, recursive=True)
    out["normalise_changes"] = with_inputs(
        f"""SELECT {ids}, op, name AS schema_name, block, p AS producer, e AS editor, l AS reader, cr AS is_created, nom AS in_nomenclature, CAST(soid AS BIGINT) AS schema_oid,
 CAST(po AS BIGINT) AS producer_oid, CAST(eo AS BIGINT) AS editor_oid, CAST(lo AS BIGINT) AS reader_oid, clean_p AS clean_producer, clean_e AS clean_editor, clean_l AS clean_reader FROM c3""", REVIEW)
    out["align_block_and_name"] = with_inputs(f"SELECT {ids}, op, name AS schema_name, block, align_code FROM aligned", f"{REVIEW},\n{ALIGN}")
    out["block_name_violations"] = with_inputs(
        f"SELECT {ids}, name AS schema_name, block FROM c3 WHERE NOT (block IS NULL OR block='d' OR starts_with(name, block||'_') AND regexp_matches(block,'^[a-z]$'))", REVIEW)
    out["trash_transitions"] = with_inputs(
        f"""SELECT * FROM (SELECT {ids}, op, name AS schema_name, old_name, CASE WHEN op='INSERT' AND cr AND block='d' THEN 'enter' WHEN op='UPDATE' AND cr AND block='d' AND (old_block IS NULL OR old_block<>'d' OR NOT old_cr) THEN 'enter'
 WHEN op='UPDATE' AND cr AND old_block='d' AND (block IS NULL OR block<>'d') THEN 'leave' END AS transition FROM aligned) WHERE transition IS NOT NULL""", f"{REVIEW},\n{ALIGN}")
    out["registry_duplicates"] = with_inputs(
        """SELECT CAST(db_id AS BIGINT) AS db_id, key, CAST(count(*) AS BIGINT) AS copies, 'name' AS kind FROM (SELECT db_id, schema_name AS key FROM registry UNION ALL SELECT db_id, name FROM aligned WHERE op<>'DELETE') GROUP BY db_id, key HAVING count(*)>1
 UNION ALL SELECT CAST(db_id AS BIGINT), ''||key, CAST(count(*) AS BIGINT), 'oid' FROM (SELECT db_id, schema_oid AS key FROM registry UNION ALL SELECT db_id, soid FROM aligned WHERE op<>'DELETE') WHERE key IS NOT NULL GROUP BY db_id, key HAVING count(*)>1""",
        f"{REVIEW},\n{ALIGN}")
    row = "CAST({0}.db_id AS BIGINT) AS db_id, {0}.block, {0}.in_nomenclature, {0}.level1, {0}.level2, {0}.schema_name, CAST({0}.schema_oid AS BIGINT) AS schema_oid, {0}.is_created, {0}.producer, CAST({0}.producer_oid AS BIGINT) AS producer_oid, {0}.editor, CAST({0}.editor_oid AS BIGINT) AS editor_oid, {0}.reader, CAST({0}.reader_oid AS BIGINT) AS reader_oid"
    out["apply_registry_changes"] = with_inputs(
        f"""SELECT {row.format('r')} FROM registry r WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.db_id=r.db_id AND ok.old_name=r.schema_name)
 UNION ALL SELECT {row.format('x')} FROM (SELECT o.db_id, o.block, o.nom AS in_nomenclature, r.level1, r.level2, o.name AS schema_name, CASE WHEN o.cr THEN coalesce(o.soid, n.schema_oid) END AS schema_oid, o.cr AS is_created, o.p AS producer, o.fpo AS producer_oid, o.e AS editor, o.feo AS editor_oid, o.l AS reader, o.flo AS reader_oid
 FROM ok o LEFT JOIN registry r ON r.db_id=o.db_id AND r.schema_name=o.old_name LEFT JOIN namespaces n ON n.db_id=o.db_id AND n.schema_name=o.name WHERE o.op<>'DELETE') x""", full, recursive=True)
    out["register_unlisted_schemas"] = with_inputs(
        """SELECT CAST(n.db_id AS BIGINT) AS db_id, CAST(n.schema_oid AS BIGINT) AS schema_oid, n.schema_name, CASE WHEN r.schema_name IS NULL THEN 'insert' ELSE 'update' END AS action, w.role_name AS producer
 FROM namespaces n LEFT JOIN registry r ON r.db_id=n.db_id AND r.schema_name=n.schema_name LEFT JOIN roles w ON w.role_oid=n.owner_oid
 WHERE NOT regexp_matches(n.schema_name,'^pg_toast|^pg_temp|^pg_catalog$|^public$|^information_schema$|^topology$') AND (r.is_created IS NULL OR NOT r.is_created)""")
    out["deregister_schemas"] = with_inputs(
        """SELECT CAST(d.db_id AS BIGINT) AS db_id, d.schema_name, CASE WHEN r.schema_name IS NULL THEN 'unknown' WHEN r.in_nomenclature THEN 'TB26' ELSE 'removed' END AS answer FROM (SELECT DISTINCT db_id, schema_name FROM deregistrations) d LEFT JOIN registry r ON r.db_id=d.db_id AND r.schema_name=d.schema_name
 UNION ALL SELECT CAST(db_id AS BIGINT), schema_name, 'kept' FROM registry r WHERE in_nomenclature OR NOT EXISTS (SELECT 1 FROM deregistrations d WHERE d.db_id=r.db_id AND d.schema_name=r.schema_name)""")
    out["import_taxonomy"] = with_inputs(
        """SELECT t.schema_name, t.block, t.level1, t.level2, t.producer, t.editor, t.reader, CAST(d.db_id AS BIGINT) AS db_id,
 CASE WHEN r.schema_name IS NULL THEN 'insert' WHEN NOT r.in_nomenclature OR coalesce(r.level1,'')<>coalesce(t.level1,'') OR coalesce(r.level2,'')<>coalesce(t.level2,'') THEN 'update' ELSE 'none' END AS action
 FROM nomenclature t CROSS JOIN (SELECT DISTINCT db_id FROM registry) d LEFT JOIN registry r ON r.db_id=d.db_id AND r.schema_name=t.schema_name""")
    return out


# Rows of the registry by name: lives of ids, linked where a name is created again after a drop.
FOLD = """births AS (SELECT * FROM (SELECT db_id, schema_oid, schema_name, owner_oid, ts, event_id, row_number() OVER (PARTITION BY schema_oid ORDER BY ts, event_id) AS rn FROM ddl_events WHERE tag='CREATE SCHEMA') WHERE rn=1),
alters AS (SELECT * FROM (SELECT e.schema_oid, e.schema_name, e.owner_oid, row_number() OVER (PARTITION BY e.schema_oid ORDER BY e.ts DESC, e.event_id DESC) AS rn FROM ddl_events e JOIN births b ON b.schema_oid=e.schema_oid WHERE e.tag='ALTER SCHEMA' AND (e.ts, e.event_id)>(b.ts, b.event_id)) WHERE rn=1),
drops AS (SELECT * FROM (SELECT schema_oid, ts, event_id, row_number() OVER (PARTITION BY schema_oid ORDER BY ts, event_id) AS rn FROM ddl_events WHERE tag='DROP SCHEMA') WHERE rn=1),
lived AS (SELECT b.db_id, b.schema_oid, b.schema_name AS born_name, coalesce(a.schema_name, b.schema_name) AS schema_name, CASE WHEN a.schema_oid IS NULL THEN b.owner_oid ELSE a.owner_oid END AS owner_oid, d.schema_oid IS NULL AS live, a.schema_oid IS NOT NULL AS was_altered, b.ts AS bt, b.event_id AS be, d.ts AS dt, d.event_id AS de
 FROM births b LEFT JOIN alters a ON a.schema_oid=b.schema_oid LEFT JOIN drops d ON d.schema_oid=b.schema_oid),
turns AS (SELECT db_id, born_name AS name, bt AS ts, be AS event_id, schema_oid AS born, CAST(NULL AS HUGEINT) AS dead FROM lived UNION ALL SELECT db_id, schema_name, dt, de, NULL, schema_oid FROM lived WHERE NOT live),
links AS (SELECT born AS child, before AS parent FROM (SELECT born, lag(dead) OVER (PARTITION BY db_id, name ORDER BY ts, event_id) AS before FROM turns) WHERE born IS NOT NULL),
firsts AS (SELECT db_id, born_name AS root, min((bt, be)) AS at FROM lived GROUP BY db_id, born_name),
chains AS (SELECT l.schema_oid AS head, l.schema_oid AS member FROM lived l JOIN links k ON k.child=l.schema_oid WHERE k.parent IS NULL
 UNION ALL SELECT c.head, k.child FROM chains c JOIN links k ON k.parent=c.member),
eventreg AS (SELECT l.db_id, l.schema_name, CASE WHEN l.live THEN CAST(l.schema_oid AS BIGINT) END AS schema_oid, l.live AS is_created, CAST(l.owner_oid AS BIGINT) AS producer_oid, CAST(p.editor_oid AS BIGINT) AS editor_oid, CAST(p.reader_oid AS BIGINT) AS reader_oid, l.was_altered
 FROM lived l JOIN chains c ON c.member=l.schema_oid JOIN lived h ON h.schema_oid=c.head LEFT JOIN firsts f ON f.db_id=h.db_id AND f.root=h.born_name AND f.at=(h.bt, h.be) LEFT JOIN preregistered p ON p.db_id=f.db_id AND p.schema_name=f.root
 WHERE l.schema_oid NOT IN (SELECT parent FROM links WHERE parent IS NOT NULL)
 UNION ALL SELECT db_id, schema_name, NULL, false, CAST(producer_oid AS BIGINT), CAST(editor_oid AS BIGINT), CAST(reader_oid AS BIGINT), false FROM preregistered p WHERE NOT EXISTS (SELECT 1 FROM lived l WHERE l.db_id=p.db_id AND l.born_name=p.schema_name))"""


def events() -> dict[str, str]:
    columns = "CAST(db_id AS BIGINT) AS db_id, schema_name, schema_oid, is_created, producer_oid, editor_oid, reader_oid, nullif(regexp_extract(schema_name,'^([a-z])_',1),'') AS block"
    kinds = "e.obj_kind IN ('r','p','v','m','f','S')"
    base = "CAST(e.event_id AS BIGINT) AS event_id, l.schema_name, CAST(e.obj_oid AS BIGINT) AS obj_oid, e.obj_kind"
    made = "FROM ddl_events e JOIN live l ON l.schema_oid=e.schema_oid WHERE e.tag='CREATE OBJECT' AND l.producer_oid IS NOT NULL"
    return {
        "registry_from_events": with_inputs(f"SELECT {columns} FROM eventreg", FOLD, recursive=True),
        "registry_on_create": with_inputs(f"SELECT {columns} FROM eventreg WHERE is_created", FOLD, recursive=True),
        "registry_on_alter": with_inputs(f"SELECT {columns} FROM eventreg WHERE was_altered AND is_created", FOLD, recursive=True),
        "registry_on_drop": with_inputs(f"SELECT {columns} FROM eventreg WHERE NOT is_created", FOLD, recursive=True),
        "grants_on_create_object": with_inputs(
            f"""SELECT {base}, 'producer' AS function, 'OWNER' AS verb, CAST(NULL AS VARCHAR) AS privilege, CAST(l.producer_oid AS BIGINT) AS role_oid {made} AND e.owner_oid<>l.producer_oid
 UNION ALL SELECT {base}, 'editor', 'GRANT', CASE WHEN e.obj_kind='S' THEN 'SELECT, USAGE' ELSE 'SELECT, INSERT, UPDATE, DELETE' END, CAST(l.editor_oid AS BIGINT) {made} AND l.editor_oid IS NOT NULL AND {kinds}
 UNION ALL SELECT {base}, 'reader', 'GRANT', 'SELECT', CAST(l.reader_oid AS BIGINT) {made} AND l.reader_oid IS NOT NULL AND {kinds}""", LIVE),
        "view_warnings_on_create": with_inputs(
            f"SELECT * FROM ({D6}) WHERE obj_oid IN (SELECT obj_oid FROM ddl_events WHERE tag='CREATE OBJECT' AND obj_kind IN ('v','m'))",
            f"{PRIV},\n{KIND},\n{LIVE},\n{USAGE},\n{SUPERS},\n{SOURCES},\n{HOLDS}", recursive=True),
        "owner_on_alter_object": with_inputs(
            """SELECT CAST(e.event_id AS BIGINT) AS event_id, r.schema_name, CAST(e.obj_oid AS BIGINT) AS obj_oid, e.obj_kind, 'OWNER' AS verb, CAST(r.producer_oid AS BIGINT) AS role_oid
 FROM ddl_events e JOIN registry r ON r.schema_oid=e.schema_oid WHERE e.tag='ALTER OBJECT' AND r.is_created AND e.owner_oid<>r.producer_oid"""),
    }


def policies() -> dict[str, str]:
    graph = f"{USAGE},\n{SUPERS}"
    named = """named AS (SELECT r.schema_name, p.role_oid AS p, e.role_oid AS e, l.role_oid AS l FROM registry r LEFT JOIN roles p ON p.role_name=r.producer LEFT JOIN roles e ON e.role_name=r.editor LEFT JOIN roles l ON l.role_name=r.reader)"""
    flags = f"""flags AS (SELECT q.user_oid, q.style_id, NOT s.use_as_default AS nodef, {has('q.user_oid', 'n.p')} AS is_p, {has('q.user_oid', 'n.e')} AS is_e, {has('q.user_oid', 'n.l')} AS is_l, {has('q.user_oid', 'o.role_oid')} AS has_o,
 {has('q.user_oid', '10')} AS adm, {has('q.user_oid', '12')} AS con, q.user_oid IN (SELECT role_oid FROM supers) AS sup
 FROM style_requests q JOIN layer_styles s ON s.style_id=q.style_id LEFT JOIN named n ON n.schema_name=s.f_table_schema LEFT JOIN roles o ON o.role_name=s.owner),
strat(strategy) AS (VALUES (0),(1),(2),(3),(4),(5),(99)),
rules AS (SELECT f.*, t.strategy, CASE t.strategy WHEN 0 THEN adm WHEN 99 THEN sup ELSE (adm OR con) AND (sup OR user_oid=10 OR is_p OR (t.strategy IN (2,5) AND is_e AND has_o AND nodef) OR (t.strategy=3 AND is_e AND has_o) OR (t.strategy=4 AND is_e) OR (t.strategy=5 AND is_l AND has_o AND nodef)) END AS w,
 CASE t.strategy WHEN 99 THEN sup ELSE adm OR con END AS r FROM flags f CROSS JOIN strat t)"""
    readable = """readable AS (SELECT o.db_id, o.obj_oid, o.obj_name, n.schema_name, g.level1, g.level2 FROM all_objects o JOIN namespaces n ON n.schema_oid=o.schema_oid JOIN registry g ON g.db_id=o.db_id AND g.schema_name=n.schema_name AND g.is_created
 WHERE o.obj_kind IN ('r','p','v','m','f') AND o.obj_oid IN (SELECT obj_oid FROM holds h WHERE h.privilege='SELECT' AND (h.role_oid=0 OR h.role_oid IN (SELECT role_oid FROM usage_reach WHERE member_oid=101)))
 AND o.schema_oid IN (SELECT schema_oid FROM uses u WHERE u.role_oid=0 OR u.role_oid IN (SELECT role_oid FROM usage_reach WHERE member_oid=101)))"""
    uses = """uses AS (SELECT a.schema_oid, a.grantee_oid AS role_oid FROM all_acl a WHERE a.obj_kind='N' AND contains(a.codes,'U') UNION SELECT o.schema_oid, o.owner_oid FROM all_objects o WHERE o.obj_kind='N' AND NOT o.has_acl)"""
    menu = f"""i1 AS (SELECT db_id, level1 IS NULL AS n1, coalesce(level1, schema_name) AS one, row_number() OVER (PARTITION BY db_id ORDER BY level1 IS NULL, coalesce(level1, schema_name))-1 AS ind FROM registry WHERE is_created GROUP BY db_id, level1 IS NULL, coalesce(level1, schema_name)),
i2 AS (SELECT db_id, level1 IS NULL AS n1, coalesce(level1, schema_name) AS one, level2 IS NULL AS n2, coalesce(level2, obj_name) AS two, row_number() OVER (PARTITION BY db_id, level1 IS NULL, coalesce(level1, schema_name) ORDER BY level2 IS NULL, coalesce(level2, obj_name))-1 AS ind FROM readable GROUP BY db_id, level1 IS NULL, coalesce(level1, schema_name), level2 IS NULL, coalesce(level2, obj_name)),
m AS (SELECT r.*, r.level1 IS NULL AS n1, coalesce(r.level1, r.schema_name) AS one, r.level2 IS NULL AS n2, coalesce(r.level2, r.obj_name) AS two, g.geom_column, g.srid, g.geom_type FROM readable r LEFT JOIN geometry_columns g ON g.obj_oid=r.obj_oid),
m2 AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY n1, one, n2, two, obj_name, obj_oid, geom_column NULLS FIRST) AS id, row_number() OVER (PARTITION BY db_id, n1, one, n2, two ORDER BY obj_name, obj_oid, geom_column NULLS FIRST)-1 AS ind3 FROM m)"""
    return {
        "style_row_permissions": with_inputs(
            "SELECT CAST(user_oid AS BIGINT) AS user_oid, CAST(style_id AS BIGINT) AS style_id, strategy, r AS can_select, w AS can_insert, w AS can_update, w AS can_delete FROM rules", f"{graph},\n{named},\n{flags}", recursive=True),
        "menu_index": with_inputs(
            f"""SELECT CAST(m2.db_id AS BIGINT) AS db_id, m2.id, CAST(obj_oid AS BIGINT) AS obj_oid, obj_name||CASE WHEN geom_column IS NOT NULL AND geom_column<>'geom' THEN '.'||geom_column ELSE '' END AS name,
 '[[0, "DB_'||m2.db_id||'"], ['||i1.ind||', "'||replace(m2.one,'&','et')||'"], ['||i2.ind||', "'||replace(m2.two,'&','et')||'"]'||CASE WHEN level2 IS NOT NULL THEN ', ['||ind3||', "'||obj_name||'"]' ELSE '' END||']' AS model_index,
 'vector:postgres:'||obj_name||':'||'dbname='||chr(39)||'db_'||m2.db_id||chr(39)||' '||' host=localhost port=5432 sslmode=require'||CASE WHEN srid IS NOT NULL THEN ' srid='||srid ELSE '' END||CASE WHEN geom_type IS NOT NULL THEN ' type='||geom_type ELSE '' END
 ||' table="'||schema_name||'"."'||obj_name||CASE WHEN geom_column IS NOT NULL THEN '" ('||geom_column||') sql=::' ELSE '" sql=:::::NoGeometry' END AS datasource_uri
 FROM m2 JOIN i1 ON i1.db_id=m2.db_id AND i1.n1=m2.n1 AND i1.one=m2.one JOIN i2 ON i2.db_id=m2.db_id AND i2.n1=m2.n1 AND i2.one=m2.one AND i2.n2=m2.n2 AND i2.two=m2.two""",
            f"{PRIV},\n{KIND},\n{graph},\n{HOLDS},\n{uses},\n{readable},\n{menu}", recursive=True),
    }


def stores() -> dict[str, str]:
    graph = f"{USAGE},\n{SUPERS}"
    order = "db_id, schema_oid, grantor_oid, grantee_oid, object_class, privilege"
    return {
        "read_taxonomy": with_inputs(
            "SELECT block, level1, level2, schema_name, producer, editor, reader FROM nomenclature WHERE level1 IN ('Brand#11*','Brand#23*','Brand#35*','Brand#42*','Brand#54*')"),
        "read_ddl_events": with_inputs(
            f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, tag, object_type, {big('db_id', 'event_id', 'schema_oid', 'owner_oid', 'obj_oid')}, schema_name, obj_kind FROM ddl_events s WHERE tag<>'DROP OWNED'"),
        "write_plan": with_inputs(
            f"""SELECT row_number() OVER (ORDER BY {order}) AS seq, {big('db_id', 'schema_oid', 'grantor_oid', 'grantee_oid')}, object_class, privilege, CASE WHEN is_usable THEN revoke_command END AS command FROM ({default_commands('default_acl')}) s""",
            f"{PLAN},\n{graph},\n{DEFAULTS}", recursive=True),
        "commit_registry": with_inputs(
            """SELECT * FROM (SELECT CAST(coalesce(u.db_id, r.db_id) AS BIGINT) AS db_id, coalesce(u.schema_name, r.schema_name) AS schema_name, CAST(coalesce(u.schema_oid, r.schema_oid) AS BIGINT) AS schema_oid, coalesce(u.schema_oid IS NOT NULL, false) OR r.is_created AS is_created, coalesce(u.producer, r.producer) AS producer
 FROM registry r FULL JOIN (SELECT n.db_id, n.schema_name, n.schema_oid, w.role_name AS producer FROM namespaces n LEFT JOIN registry g ON g.db_id=n.db_id AND g.schema_name=n.schema_name LEFT JOIN roles w ON w.role_oid=n.owner_oid
  WHERE NOT regexp_matches(n.schema_name,'^pg_toast|^pg_temp|^pg_catalog$|^public$|^information_schema$|^topology$') AND (g.is_created IS NULL OR NOT g.is_created)) u ON u.db_id=r.db_id AND u.schema_name=r.schema_name) x
 WHERE NOT EXISTS (SELECT 1 FROM deregistrations d WHERE d.db_id=x.db_id AND d.schema_name=x.schema_name)"""),
        "write_registry": with_inputs(
            """SELECT CAST(coalesce(u.db_id, r.db_id) AS BIGINT) AS db_id, coalesce(u.schema_name, r.schema_name) AS schema_name, CAST(coalesce(u.schema_oid, r.schema_oid) AS BIGINT) AS schema_oid, coalesce(u.schema_oid IS NOT NULL, false) OR r.is_created AS is_created, coalesce(u.producer, r.producer) AS producer
 FROM registry r FULL JOIN (SELECT n.db_id, n.schema_name, n.schema_oid, w.role_name AS producer FROM namespaces n LEFT JOIN registry g ON g.db_id=n.db_id AND g.schema_name=n.schema_name LEFT JOIN roles w ON w.role_oid=n.owner_oid
  WHERE NOT regexp_matches(n.schema_name,'^pg_toast|^pg_temp|^pg_catalog$|^public$|^information_schema$|^topology$') AND (g.is_created IS NULL OR NOT g.is_created)) u ON u.db_id=r.db_id AND u.schema_name=r.schema_name"""),
    }


def fleet(name: str) -> str:
    return f"CAST(db_id AS BIGINT)*4294967296+CAST({name} AS BIGINT) AS {name}"


def snapshots() -> dict[str, str]:
    keys = f"CAST(db_id AS BIGINT) AS db_id, {fleet('schema_oid')}, obj_kind, {fleet('obj_oid')}"
    of_relation = "JOIN objects o ON o.obj_oid="
    return {
        "read_catalog_snapshot": with_inputs(f"SELECT {keys}, obj_name, CAST(owner_oid AS BIGINT) AS owner_oid, has_acl FROM all_objects"),
        "read_catalog_acl": with_inputs(
            f"SELECT {keys}, column_name, CAST(owner_oid AS BIGINT) AS owner_oid, CAST(grantee_oid AS BIGINT) AS grantee_oid, codes, grantable FROM all_acl"),
        "read_default_acl": with_inputs(
            f"SELECT CAST(db_id AS BIGINT) AS db_id, {fleet('schema_oid')}, CAST(grantor_oid AS BIGINT) AS grantor_oid, obj_type, CAST(grantee_oid AS BIGINT) AS grantee_oid, codes FROM default_acl"),
        "read_rejected_acl": with_inputs(
            f"SELECT CAST(db_id AS BIGINT) AS db_id, obj_kind, {fleet('obj_oid')}, column_name, count(*) AS items FROM all_acl WHERE grantee_oid IN (SELECT role_oid FROM roles WHERE role_name LIKE 'prod%') GROUP BY ALL"),
        "snapshot_privilege_anomalies": diagnostics()["privilege_anomalies"],
        "snapshot_role_privileges": acl()["role_privileges"],
        "read_roles": with_inputs("SELECT CAST(role_oid AS BIGINT) AS role_oid, role_name, can_login, is_super, can_create_role, inherits FROM roles"),
        "read_memberships": with_inputs(
            "SELECT CAST(role_oid AS BIGINT) AS role_oid, CAST(member_oid AS BIGINT) AS member_oid, bool_or(admin_option) AS admin_option FROM memberships GROUP BY role_oid, member_oid"),
        "read_view_sources": with_inputs(
            f"SELECT DISTINCT CAST(db_id AS BIGINT)*4294967296+view_oid AS view_oid, CAST(db_id AS BIGINT)*4294967296+source_oid AS source_oid FROM view_sources {of_relation}view_oid"),
        "read_owned_sequences": with_inputs(
            "SELECT CAST(s.db_id AS BIGINT)*4294967296+table_oid AS table_oid, CAST(s.db_id AS BIGINT)*4294967296+sequence_oid AS owned_oid, s.obj_name AS owned_name FROM owned_sequences JOIN objects s ON s.obj_oid=sequence_oid"),
        "read_auto_types": with_inputs(f"SELECT CAST(db_id AS BIGINT)*4294967296+t.obj_oid AS obj_oid FROM auto_types t {of_relation}t.obj_oid"),
        "read_role_dependencies": with_inputs("SELECT CAST(db_id AS BIGINT) AS db_id, CAST(role_oid AS BIGINT) AS role_oid FROM role_dependencies"),
    }


def on_servers(name: str, databases: str = "db_id%2=1") -> str:
    """Id of a role in the fleet of two servers; server 1 has the ids of all roles in reverse."""
    there = f"4294967296+(SELECT min(role_oid)+max(role_oid) FROM roles)-{name}"
    return f"CAST(CASE WHEN {name}=0 THEN 0 WHEN {databases} THEN {there} ELSE {name} END AS BIGINT)"


def servers() -> dict[str, str]:
    keys = f"CAST(db_id AS BIGINT) AS db_id, {fleet('schema_oid')}, obj_kind, {fleet('obj_oid')}"
    second = lambda name: on_servers(name, "server_id=1")
    return {
        "read_server_acl": with_inputs(
            f"SELECT {keys}, column_name, {on_servers('owner_oid')} AS owner_oid, {on_servers('grantee_oid')} AS grantee_oid, codes, grantable FROM all_acl"),
        "read_server_dependencies": with_inputs(
            f"SELECT CAST(db_id AS BIGINT) AS db_id, {on_servers('role_oid')} AS role_oid FROM role_dependencies"),
        "server_role_closure": with_inputs(
            f"SELECT {second('member_oid')} AS member_oid, {second('role_oid')} AS role_oid FROM usage_reach, (VALUES (0),(1)) v(server_id)",
            USAGE, recursive=True),
        "server_privilege_anomalies": diagnostics()["privilege_anomalies"],
    }


def all_oracles() -> dict[str, str]:
    return {
        **diagnostics(), **acl(), **roles(), **plans(), **registry(), **events(), **policies(),
        **stores(), **snapshots(), **servers(),
    }
