"""Catalog tables derived from the given star schema.

Each definition is plain SQL that both engines run unchanged; later ones build on earlier ones.
``Inputs`` turns them into DataFrames, ``with_inputs`` into the CTE list of an oracle query.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.scaling import shared_folder, weigh_in_memory

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DEFINITIONS = {
    "roles": """
select * from (values (10,'g_admin',false,false,true,true),(11,'g_admin_ext',false,false,false,true),(12,'g_consult',false,false,false,true),(13,'consult.defaut',true,false,false,true)) t(role_oid,role_name,can_login,is_super,can_create_role,inherits)
union all select 50+r_regionkey,'reg_'||r_regionkey,false,false,false,true from region
union all select 100+n_nationkey,'grp_'||n_nationkey,false,false,n_nationkey%5=0,n_nationkey%7<>3 from nation
union all select 1000+s_suppkey,case when s_suppkey%13=5 then 'prod_'||s_suppkey||'_v2' else 'prod_'||s_suppkey end,s_suppkey%40=11,s_suppkey%50=7,false,true from supplier
union all select 1000000+c_custkey,case when c_custkey%10=3 then 'Usr.'||c_custkey else 'usr_'||c_custkey end,true,c_custkey%500=499,false,c_custkey%11<>0 from customer
""",
    "memberships": """
select 100+c_nationkey as role_oid,1000000+c_custkey as member_oid,c_custkey%29=0 as admin_option from customer
union all select 12,1000000+c_custkey,false from customer where c_custkey%3=0
union all select 50+n_regionkey,100+n_nationkey,false from nation
union all select 12,50+r_regionkey,false from region where r_regionkey<2
union all select 1000+s_suppkey,100+s_nationkey,false from supplier
union all select 1000+s_suppkey,10,true from supplier where s_suppkey%2=0
union all select * from (values (11,10,false),(12,13,false)) t(a,b,c)
union all select 10,1000+s_suppkey,false from supplier where s_suppkey%34=3
""",
    "registry": """
with p as (select p.*, 1000+p_partkey%(select count(*) from supplier) as prod_oid,
  case when p_size%9=0 then null else substr('cwsprxez',1+p_size%8,1) end as pfx from part p)
select p_partkey%4 as db_id, case when p_size=50 then 'd' else pfx end as block, p_size%6=0 as in_nomenclature,
 case when p_size%5=0 then null else p_brand end as level1, case when p_size%7=0 then null else p_type end as level2,
 coalesce(pfx||'_','')||'sch_'||p_partkey as schema_name,
 case when p_partkey%10<>9 then 5000000+p_partkey end as schema_oid, p_partkey%10<>9 as is_created,
 'prod_'||(prod_oid-1000) as producer, case when p_partkey%10<>9 then prod_oid end as producer_oid,
 case when p_size%3<>0 then 'grp_'||(p_partkey%25) end as editor, case when p_size%3<>0 and p_partkey%10<>9 then case when p_partkey%31=0 then 900 else 100+p_partkey%25 end end as editor_oid,
 case p_size%4 when 0 then 'public' when 1 then null else 'g_consult' end as reader,
 case when p_partkey%10<>9 then case p_size%4 when 0 then 0 when 1 then null else 12 end end as reader_oid
from p
""",
    "namespaces": """
select db_id, schema_oid, case when schema_oid%23=0 then schema_name||'_ren' else schema_name end as schema_name,
  case when schema_oid%17=0 then 1000+(producer_oid-1000+1)%(select count(*) from supplier) else producer_oid end as owner_oid
from registry where is_created
union all select db_id, 6000000+cast(regexp_replace(schema_name,'^.*_','') as bigint), schema_name, 10 from registry where not is_created and block='c'
union all select r_regionkey%4, 8000000+r_regionkey, 'legacy_'||r_regionkey, 1000+r_regionkey from region
union all select * from (values (0,9000001,'pg_toast',10),(0,9000002,'public',10),(0,9000003,'information_schema',10),(0,9000004,'pg_catalog',10)) t(a,b,c,d)
""",
    "objects": """
with o as (select l_orderkey*10+l_linenumber as obj_oid, min(l_linenumber) as ln, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_quantity) as q from lineitem group by l_orderkey*10+l_linenumber)
select pk%4 as db_id, obj_oid, 5000000+pk as schema_oid,
 case ln when 1 then 'r' when 2 then 'p' when 3 then 'v' when 4 then 'm' when 5 then 'S' when 6 then 'X' else 'T' end as obj_kind,
 case when obj_oid%10=2 and obj_oid%3=0 then 'Obj '||(obj_oid%10007) else 'obj_'||(obj_oid%10007) end as obj_name,
 case when sk%13=0 then 1000+sk else 1000+pk%(select count(*) from supplier) end as owner_oid,
 q>5 as has_acl
from o
""",
    "acl_items": """
select o.db_id,o.obj_oid,o.schema_oid,o.obj_kind,o.owner_oid, o.owner_oid as grantor_oid,
 case l_returnflag when 'A' then o.owner_oid when 'N' then coalesce(r.editor_oid,100+l_suppkey%25) else case when l_suppkey%3=0 then 0 else coalesce(r.reader_oid,12) end end as grantee_oid,
 case when o.obj_kind='S' then case when l_quantity>25 then 'rwU' else 'rU' end when o.obj_kind='X' then 'X' when o.obj_kind='T' then 'U'
   else case l_returnflag when 'A' then case when l_quantity>25 then 'rawdDxt' else 'rawd' end when 'N' then case when l_quantity>25 then 'rawd' else 'raw' end else case when l_quantity>45 then 'rd' else 'r' end end end as codes,
 l_discount>0.095 as grantable
from lineitem l join objects o on o.obj_oid=l.l_orderkey*10+l.l_linenumber left join registry r on r.schema_oid=o.schema_oid
where o.has_acl
""",
    "column_acl": """
select o.db_id,o.obj_oid,o.schema_oid,'col_'||cast(l_quantity as int) as column_name, case when l_returnflag='A' then 0 else 100+l_suppkey%25 end as grantee_oid, case when l_linestatus='O' then 'r' else 'rw' end as codes, l_discount>0.095 as grantable from lineitem l join objects o on o.obj_oid=l_orderkey*10+l_linenumber where o.obj_kind in ('r','p')
""",
    "default_acl": """
select (o_orderkey%(select count(*) from part))%4 as db_id, 5000000+o_orderkey%(select count(*) from part) as schema_oid, 1000+o_custkey%(select count(*) from supplier) as grantor_oid,
 case o_orderpriority when '1-URGENT' then 'r' when '2-HIGH' then 'S' when '3-MEDIUM' then 'f' when '5-LOW' then 'n' else 'T' end as obj_type, case when o_custkey%9=0 then 0 else 100+o_custkey%25 end as grantee_oid,
 case o_orderpriority when '1-URGENT' then 'rw' when '2-HIGH' then 'rU' when '3-MEDIUM' then 'X' when '5-LOW' then 'UC' else 'U' end as codes
from orders
""",
    "view_sources": """
select v.obj_oid as view_oid, s.obj_oid as source_oid from objects v join objects s on s.obj_oid=v.obj_oid-v.obj_oid%10+1 where v.obj_kind in ('v','m')
""",
    "owned_sequences": """
select t.obj_oid as table_oid, s.obj_oid as sequence_oid from objects t join objects s on s.obj_oid=t.obj_oid+4 where t.obj_kind='r' and s.obj_kind='S'
""",
    "object_moves": """
select obj_oid, schema_oid as source_schema_oid, 5000000+(schema_oid-5000000+1)%(select count(*) from part) as target_schema_oid, 1+obj_oid%6 as variant from objects
""",
    "nomenclature": """
select substr('cwsprxez',1+p_size%8,1) as block, p_brand||'*' as level1, p_type as level2, substr('cwsprxez',1+p_size%8,1)||'_sch_'||(p_partkey*2) as schema_name, 'g_admin' as producer, cast(null as string) as editor, 'g_consult' as reader from part where p_size%9<>0
""",
    # Several edits of each schema of the registry, created or not.
    "registry_changes": """
with c as (select o_orderkey%(select count(*) from part) as pk, o_orderkey as k, o_orderstatus as st, o_custkey as ck from orders)
select k as change_id, case st when 'O' then 'INSERT' when 'F' then 'UPDATE' else 'DELETE' end as op, 5000000+pk as target_schema_oid, 1000000+ck as actor_oid,
 case k%6 when 0 then 'd_sch_'||pk when 1 then '' when 2 then 'sch_'||pk when 3 then 'w_new_'||pk when 4 then 'c_sch_'||(pk+1) else 'plain'||pk end as new_schema_name,
 case k%5 when 0 then null when 1 then 'd' when 2 then 'w' when 3 then 'Z' else '' end as new_block,
 case when k%4=0 then '' else 'prod_'||((pk+case when k%5=4 then 8 else 0 end)%(select count(*) from supplier)) end as new_producer,
 case when k%3=0 then '' else 'grp_'||(ck%25) end as new_editor, case when k%8=0 then 'grp_'||(ck%25) else 'g_consult' end as new_reader, k%10<>3 as new_created, k%12=0 as new_nomenclature, cast(null as bigint) as new_schema_oid from c
""",
    "outer_acl": """
select 'DATABASE' as obj_class, 'db_'||r_regionkey as obj_name, 100+r_regionkey as grantee_oid, 'CT' as codes from region union all select 'TABLESPACE','ts_'||n_nationkey,100+n_nationkey,'C' from nation where n_nationkey%4=0 union all select 'FOREIGN SERVER','srv_'||n_nationkey,100+n_nationkey,'U' from nation where n_nationkey%4=1 union all select 'FOREIGN DATA WRAPPER','fdw_'||n_nationkey,100+n_nationkey,'U' from nation where n_nationkey%4=2 union all select 'LANGUAGE','lang_'||n_nationkey,100+n_nationkey,'U' from nation where n_nationkey%8=3 union all select 'LARGE OBJECT',''||s_suppkey,100+s_nationkey,'rw' from supplier where s_suppkey%3=0
""",
    "role_dependencies": """
select distinct db_id, owner_oid as role_oid from objects union select distinct db_id, grantee_oid from acl_items where grantee_oid<>0 union select db_id, owner_oid from namespaces
""",
    "layer_styles": """
select doc_id as style_id, r.schema_name as f_table_schema, 'usr_'||(doc_id%(select count(*) from customer)) as owner, doc_id%5=0 as use_as_default
from documents d join registry r on r.schema_oid=5000000+doc_id%(select count(*) from part)
""",
    "geometry_columns": """
select db_id, schema_oid, obj_oid, case when obj_oid%4=0 then 'shape' else 'geom' end as geom_column, 2154 as srid, case when obj_oid%3=0 then 'POINT' else 'POLYGON' end as geom_type from objects where obj_kind in ('r','v','m','p') and obj_oid%5<3
""",
    # A schema gets a new id every time it is created, keeps it while it is renamed, and is dropped
    # under the name it has then. Four databases have schemas of the same names. Some drops report objects;
    # created views are those of the snapshot, as far as it has them.
    "ddl_events": """
with e as (select event_id, ts, event_type, user_id, row_number() over (partition by user_id order by ts, event_id) as rn from events),
l as (select *, coalesce(sum(case when event_type='error' then 1 else 0 end) over (partition by user_id order by rn rows between unbounded preceding and 1 preceding),0) as life from e),
m as (select *, min(case when event_type='signup' then rn end) over (partition by user_id, life) as born, max(case when event_type='view' then rn end) over (partition by user_id, life) as altered from l),
n as (select m.*, a.event_id as altered_id from m left join e a on a.user_id=m.user_id and a.rn=m.altered and m.altered>m.born)
select case when event_type in ('click','purchase') then (event_id%(select count(*) from part))%4 else user_id%4 end as db_id,
 event_id, ts, case event_type when 'signup' then 'CREATE SCHEMA' when 'view' then 'ALTER SCHEMA' when 'error' then 'DROP SCHEMA' when 'click' then 'CREATE OBJECT' else case when event_id%7=0 then 'DROP OWNED' else 'ALTER OBJECT' end end as tag,
 case when event_type in ('click','purchase') then case event_id%5 when 0 then 'table' when 1 then 'view' when 2 then 'materialized view' when 3 then 'sequence' else 'function' end else 'schema' end as object_type,
 case when event_type in ('click','purchase') then 5000000+event_id%(select count(*) from part) else 70000000+user_id*1000+life end as schema_oid,
 case when event_type in ('click','purchase') then null
  when event_type='view' then 'c_evt_'||(user_id-user_id%4)||case when event_id%2=0 then '_v'||(event_id%3)||'x'||life else '' end
  when event_type='error' then 'c_evt_'||(user_id-user_id%4)||case when altered_id%2=0 then '_v'||(altered_id%3)||'x'||life else '' end
  else 'c_evt_'||(user_id-user_id%4) end as schema_name,
 1000+(event_id+event_id%3)%(select count(*) from supplier) as owner_oid,
 case when event_type='click' and event_id%5 in (1,2) then (1+event_id%(select max(o_orderkey) from orders))*10+2+event_id%5
  when event_type in ('click','purchase') then 20000000+event_id end as obj_oid,
 case when event_type in ('click','purchase') then case event_id%5 when 0 then 'r' when 1 then 'v' when 2 then 'm' when 3 then 'S' else 'X' end end as obj_kind from n
""",
    "preregistered": """
select distinct user_id%4 as db_id, 'c_evt_'||(user_id-user_id%4) as schema_name, 1000+user_id%(select count(*) from supplier) as producer_oid, 100+user_id%25 as editor_oid, cast(12 as bigint) as reader_oid from events where user_id%3=0
""",
    # ACL entries of schemas: owner, editor and reader, some missing, some too many.
    "schema_acl": """
select n.db_id, n.schema_oid, n.owner_oid, g.grantee_oid, g.codes, g.grantable from namespaces n join (
 select schema_oid, 1 as who, cast(null as bigint) as grantee_oid, case when schema_oid%3=0 then 'U' else 'UC' end as codes, false as grantable from registry where is_created
 union all select schema_oid, 2, editor_oid, case when schema_oid%9=0 then 'UC' else 'U' end, false from registry where is_created and editor_oid is not null and schema_oid%4<>0
 union all select schema_oid, 3, reader_oid, 'U', schema_oid%50=0 from registry where is_created and reader_oid is not null and schema_oid%5<>1) g
 on g.schema_oid=n.schema_oid where n.schema_oid%7<>2 and g.grantee_oid is not null
union all
select db_id, schema_oid, owner_oid, owner_oid, case when schema_oid%3=0 then 'U' else 'UC' end, false from namespaces where schema_oid%7<>2
""",
    # Objects and schemas in one shape.
    "all_objects": """
select db_id, schema_oid, obj_kind, obj_oid, obj_name, owner_oid, has_acl from objects
union all select db_id, schema_oid, 'N', schema_oid, schema_name, owner_oid, schema_oid%7<>2 from namespaces
""",
    # ACL entries of objects, schemas and columns in one shape.
    "all_acl": """
select db_id, schema_oid, obj_kind, obj_oid, cast(null as varchar(100)) as column_name, owner_oid, grantee_oid, codes, grantable from acl_items
union all select db_id, schema_oid, 'N', schema_oid, null, owner_oid, grantee_oid, codes, grantable from schema_acl
union all select db_id, schema_oid, 'A', obj_oid, column_name, null, grantee_oid, codes, grantable from column_acl
""",
    # Schemas with the flag that tells an ACL from the built-in defaults.
    "namespace_states": """
select db_id, schema_oid, schema_name, owner_oid, schema_oid%7<>2 as has_acl from namespaces
""",
    # Rights that some schemas must keep whatever their functions are.
    "fixed_grants": """
select schema_name, schema_name as obj_name, 'N' as obj_kind, cast(0 as bigint) as role_oid, 'U' as codes from registry where is_created and block='z'
union all select r.schema_name, o.obj_name, o.obj_kind, cast(11 as bigint), 'rawd' from registry r join objects o on o.schema_oid=r.schema_oid where r.is_created and r.block='z' and o.obj_kind='v'
""",
    # (user, schema) pairs somebody asks about.
    "access_requests": """
select distinct 1000000+o_custkey as user_oid, r.db_id, r.schema_name from orders join registry r on split_part(r.schema_name,'sch_',2)=''||(o_orderkey%(select count(*) from part))
""",
    # (user, object) pairs somebody asks about.
    "object_requests": """
select distinct 1000000+o_custkey as user_oid, l_orderkey*10+l_linenumber as obj_oid from lineitem join orders on o_orderkey=l_orderkey
""",
    # (parent role, child role) names somebody asks about; some do not exist.
    "role_pairs": """
select distinct r.producer as parent, s.owner as child from layer_styles s join registry r on r.schema_name=s.f_table_schema
union select distinct r.editor, 'usr_'||(o_custkey) from orders join registry r on r.schema_oid=5000000+o_orderkey%(select count(*) from part) where r.editor is not null
""",
    # Group roles that act on behalf of their members.
    "group_actors": """
select role_oid from roles where not can_login and not is_super and (can_create_role or role_oid in (select m.role_oid from memberships m join roles u on u.role_oid=m.member_oid where u.can_login))
""",
    # Requests to re-initialise objects, with the type the caller claims.
    "object_reset_requests": """
select obj_oid, case obj_kind when 'r' then 'table' when 'p' then 'partitioned table' when 'v' then 'view' when 'm' then 'materialized view' when 'S' then 'sequence' when 'X' then case when obj_oid%4=0 then 'procedure' else 'function' end else case when obj_oid%8=7 then 'index' else 'type' end end as obj_type from objects
""",
    # Indexes of tables, with and without a constraint.
    "table_indexes": """
select t.obj_oid as table_oid, t.schema_oid, s.obj_name as index_name, t.obj_oid%2=0 as is_constraint from objects t join objects s on s.obj_oid=t.obj_oid+1 where t.obj_kind='r'
""",
    # Types that the server made by itself for a table.
    "auto_types": """
select o.obj_oid from objects o where o.obj_kind='T' and not o.has_acl
""",
    # Edits with the database and the name of the row they are about; some rows do not exist.
    "change_sets": """
select c.*, (target_schema_oid-5000000)%4 as db_id, coalesce(r.schema_name, 'c_unknown_'||(target_schema_oid-5000000)) as target_schema_name
from registry_changes c left join registry r on split_part(r.schema_name,'sch_',2)=''||(target_schema_oid-5000000)
""",
    # The last edit of each schema.
    "last_changes": """
select * from (select c.*, max(change_id) over (partition by target_schema_oid) as newest from registry_changes c) t where change_id=newest
""",
    # Roles that may create schemas in a database.
    "database_creators": """
select cast(substr(obj_name,4) as bigint) as db_id, grantee_oid as role_oid from outer_acl where obj_class='DATABASE' and codes like '%C%'
""",
    # Schemas somebody wants out of the registry; some are unknown.
    "deregistrations": """
select r.db_id, r.schema_name from registry r join object_moves m on m.target_schema_oid=r.schema_oid union select db_id, schema_name from namespaces where schema_oid>=8000000
""",
    # (user, style) pairs somebody asks about.
    "style_requests": """
select distinct 1000000+user_id%(select count(*) from customer) as user_oid, event_id%(select count(*) from documents) as style_id from events
""",
    # Schemas whose editor or reader is about to change.
    "function_switches": """
select r.db_id, r.schema_oid, n.schema_name, 'editor' as function, case when r.editor='public' then 0 else o.role_oid end as old_oid, t.role_oid as new_oid
 from last_changes c join registry r on r.schema_oid=c.target_schema_oid join namespaces n on n.schema_oid=r.schema_oid left join roles o on o.role_oid=r.editor_oid left join roles t on t.role_name=nullif(c.new_editor,'')
 where c.op<>'DELETE' and coalesce(nullif(c.new_editor,''),'')<>coalesce(r.editor,'')
union all
select r.db_id, r.schema_oid, n.schema_name, 'reader', case when r.reader='public' then 0 else o.role_oid end, t.role_oid
 from last_changes c join registry r on r.schema_oid=c.target_schema_oid join namespaces n on n.schema_oid=r.schema_oid left join roles o on o.role_oid=r.reader_oid left join roles t on t.role_name=nullif(c.new_reader,'')
 where c.op<>'DELETE' and coalesce(nullif(c.new_reader,''),'')<>coalesce(r.reader,'')
""",
    # Schemas somebody wants to bring back to the standard; some are missing, some of the server.
    "reset_targets": """
select distinct db_id, schema_name from registry union select distinct db_id, schema_name from namespaces
""",
    # Schemas whose rights somebody asks about: those of some roles, some unknown or not created.
    "diagnosis_targets": """
select s_suppkey%4 as db_id, 'c_sch_'||s_suppkey as schema_name from supplier
union select r.db_id, r.schema_name from registry r join region g on r.reader_oid=12 and r.level1='Brand#'||(g.r_regionkey+1)||'1'
""",
    # Roles to be replaced by another one, or by nobody.
    "role_replacements": """
select 1000+s_suppkey as role_oid, case when s_suppkey%5<>4 then 1000+(s_suppkey+1)%(select count(*) from supplier) end as target_oid from supplier
union all select 100+n_nationkey, case when n_nationkey%3<>2 then 100+(n_nationkey+1)%25 end from nation
union all select 12, cast(11 as bigint) from region where r_regionkey=0
""",
}

# A value taken from one whole table. In the key of a broadcast join Spark does not wait for such a subquery.
_SCALAR = re.compile(r"\(select (?:count|max)\([*\w]+\) from (?:" + "|".join(BASE_TABLES) + r")\)")
_NAMES = re.compile(r"\b(" + "|".join(DEFINITIONS) + r")\b")


def _closure(names, found: list[str]) -> list[str]:
    for name in names:
        if name not in found:
            uses = {n for n in _NAMES.findall(DEFINITIONS[name]) if n != name}
            _closure([n for n in DEFINITIONS if n in uses], found)
            found.append(name)
    return found


def cte_list(names) -> str:
    """Definitions of ``names`` and of all they build on, in order."""
    return ",\n".join(f"{n} AS ({DEFINITIONS[n].strip()})" for n in _closure(names, []))


def with_inputs(body: str, extra: str = "", recursive: bool = False) -> str:
    """Oracle query: the definitions its text mentions, its own CTEs, then the body."""
    text = extra + "\n" + body
    mentioned = set(_NAMES.findall(text))
    head = cte_list([n for n in DEFINITIONS if n in mentioned])
    ctes = ",\n".join(part for part in (head, extra.strip()) if part)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


class Inputs:
    """Catalog tables of one test-data folder as DataFrames, by attribute.

    A table is derived once per session, written as Parquet to the shared folder, and read back
    by every query: scans prune columns and filters, and size estimates are those of real files,
    weighed by what their rows take in memory.
    """

    _landed: dict[tuple[str, str], dict[str, str]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        weigh_in_memory(spark)
        self._paths = self._landed.setdefault((spark.sparkContext.applicationId, sf_dir), {})
        self._sf_dir = sf_dir

    def land(self, name: str, derive) -> DataFrame:
        """Table ``name`` of this session, derived and written on first use."""
        return self.land_with(name, lambda path: derive().write.parquet(path, compression="zstd"))

    def land_with(self, name: str, write) -> DataFrame:
        """As :meth:`land`, with ``write(path)`` to lay the files out."""
        if name not in self._paths:
            path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}/{name}"
            write(path)
            self._paths[name] = path
        return self.spark.read.parquet(self._paths[name])

    def path_of(self, name: str) -> str:
        """Folder of a derived table."""
        getattr(self, name)
        return self._paths[name]

    def _derive(self, name: str) -> DataFrame:
        words = set(re.findall(r"\w+", DEFINITIONS[name]))
        for used in words.intersection(DEFINITIONS) - {name}:
            derived = getattr(self, used)
            derived.createOrReplaceTempView(used)
        for used in words.intersection(BASE_TABLES):
            self.spark.read.parquet(f"{self._sf_dir}/{used}.parquet").createOrReplaceTempView(used)
        df = self.spark.sql(_SCALAR.sub(self._value, DEFINITIONS[name].strip()))
        return df.select(
            *[
                F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c)
                for c, t in df.dtypes
            ]
        )

    def _value(self, subquery: re.Match) -> str:
        found = self.spark.sql(subquery[0][1:-1]).first()[0]
        return f"cast({'null' if found is None else found} as bigint)"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DEFINITIONS:
            raise AttributeError(name)
        return self.land(name, lambda: self._derive(name))
