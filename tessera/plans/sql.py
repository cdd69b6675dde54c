"""SQL (DuckDB) that states the core's own problems, for the side-by-side check."""

CLEAN = "nullif(lower(trim({0}, ' \t\r\n')), '')"


def clean(c: str) -> str:
    return CLEAN.format(c)


_VERSIONS = f"""
own as (
  select run_id, {clean('edge_id')} as edge_id, any_value({clean('from_id')}) as from_id, any_value(edge_type) as edge_type,
         any_value(valid_from) as valid_from, any_value(valid_to) as valid_to, min(recorded_at) as recorded_at,
         any_value({clean('supersedes_edge_id')}) as target
  from graph_edges where run_id is not null and edge_id is not null group by 1, 2),
notes as (
  select run_id, target, arg_min(struct_pack(r := recorded_at, v := valid_from), coalesce(recorded_at, timestamp '9999-01-01')) as n
  from own where target is not null and target <> edge_id group by 1, 2),
versions as (
  select o.*, n.target is not null as superseded, n.n.r as next_recorded_at, n.n.v as next_valid_from
  from own o left join notes n on n.run_id = o.run_id and n.target = o.edge_id)
"""

_ISLANDS = f"""
with {_VERSIONS},
iv as (
  select distinct run_id, from_id, edge_type, valid_from as lo,
         coalesce(least(coalesce(valid_to, next_valid_from), coalesce(next_valid_from, valid_to)), timestamp '9999-01-01') as hi
  from versions where valid_from is not null),
marked as (
  select *, max(hi) over (partition by run_id, from_id, edge_type order by lo, hi rows between unbounded preceding and 1 preceding) as before
  from iv where lo < hi)
"""

P3_FOUND = _ISLANDS + """
select distinct run_id, from_id, edge_type, strftime(before, '%Y-%m-%dT%H:%M:%SZ') as gap_from, strftime(lo, '%Y-%m-%dT%H:%M:%SZ') as gap_to
from marked where before is not null and lo > before
"""

P3_PERIODS = _ISLANDS + """
, numbered as (
  select *, sum(case when before >= lo then 0 else 1 end) over (partition by run_id, from_id, edge_type order by lo, hi rows unbounded preceding) as n
  from marked)
select run_id, from_id, edge_type, strftime(min(lo), '%Y-%m-%dT%H:%M:%SZ') as period_from,
       case when max(hi) < timestamp '9999-01-01' then strftime(max(hi), '%Y-%m-%dT%H:%M:%SZ') end as period_to
from numbered group by run_id, from_id, edge_type, n
"""

P2_FOUND = f"""
with {_VERSIONS},
asked as (
  select distinct run_id, {clean('trace_id')} as trace_id, {clean('anchor_id')} as from_id, edge_type, as_of
  from retrieval_traces where as_of is not null),
hits as (
  select a.trace_id, v.edge_id,
         row_number() over (partition by a.trace_id order by v.recorded_at desc, v.valid_from desc, v.edge_id desc) as nth
  from asked a join versions v on v.run_id = a.run_id and v.from_id = a.from_id and v.edge_type = a.edge_type
  where v.recorded_at <= a.as_of and v.valid_from <= a.as_of
    and coalesce(
      case when not v.superseded then v.valid_to
           when v.next_recorded_at is null or v.next_recorded_at > a.as_of then null
           else least(coalesce(v.valid_to, v.next_valid_from), coalesce(v.next_valid_from, v.valid_to)) end,
      timestamp '9999-01-01') > a.as_of)
select trace_id, edge_id from hits where nth = 1
"""

_DEPS = f"""
deps as (
  select distinct run_id, {clean('task_id')} as child, {clean('depends_on')} as parent from task_dependencies
  where run_id is not null and {clean('task_id')} is not null and {clean('depends_on')} is not null)
"""

P1_FOUND = f"""
with recursive {_DEPS},
up(run_id, child, parent) as (
  select run_id, child, parent from deps
  union
  select u.run_id, u.child, d.parent from up u join deps d on d.run_id = u.run_id and d.child = u.parent)
select run_id, child as task_id from up where child = parent
"""

P1_DESCENDANTS = f"""
with recursive {_DEPS},
down(run_id, task_id, descendant_id) as (
  select run_id, parent, child from deps
  union
  select w.run_id, w.task_id, d.child from down w join deps d on d.run_id = w.run_id and d.parent = w.descendant_id)
select run_id, task_id, descendant_id from down
"""

# of every node: the smallest of its shortest paths from a root; nodes that no root reaches start at the smallest node on a
# cycle that reaches them and that no smaller such node reaches
_PATHS = f"""
with recursive {_DEPS},
named as (
  select distinct run_id, {clean('task_id')} as child, {clean('depends_on')} as parent from task_dependencies
  where run_id is not null and {clean('task_id')} is not null),
nodes as (select run_id, child as task_id from named union select run_id, parent from named where parent is not null),
reach(run_id, a, b) as (
  select run_id, parent, child from deps
  union
  select r.run_id, r.a, d.child from reach r join deps d on d.run_id = r.run_id and d.parent = r.b),
cyclic as (select run_id, a as task_id from reach where a = b),
roots as (select * from nodes n where not exists (select 1 from deps d where d.run_id = n.run_id and d.child = n.task_id)),
unrooted as (
  select * from nodes n where not exists (select 1 from roots r where r.run_id = n.run_id and r.task_id = n.task_id)
    and not exists (select 1 from roots r join reach x on x.run_id = r.run_id and x.a = r.task_id where r.run_id = n.run_id and x.b = n.task_id)),
free as (select u.* from unrooted u join cyclic c using (run_id, task_id)),
starts as (
  select * from roots
  union all
  select * from free f where not exists (
    select 1 from free g join reach x on x.run_id = g.run_id and x.a = g.task_id where g.run_id = f.run_id and x.b = f.task_id and g.task_id < f.task_id)),
ways(run_id, task_id, path) as (
  select run_id, task_id, [task_id] from starts
  union all
  select w.run_id, d.child, list_append(w.path, d.child) from ways w join deps d on d.run_id = w.run_id and d.parent = w.task_id
  where not list_contains(w.path, d.child)),
paths as (
  select run_id, task_id, path from ways
  qualify row_number() over (partition by run_id, task_id order by case when (run_id, path[1]) in (select (run_id, task_id) from roots) then '' else path[1] end, len(path), path) = 1)
"""

P1_HIERARCHY = _PATHS + """
select p.run_id, p.task_id, path[1] as root_id, len(path) - 1 as depth, path, c.task_id is not null as in_cycle
from paths p left join cyclic c on c.run_id = p.run_id and c.task_id = p.task_id
"""

P1_BACK_EDGES = _PATHS + """
select d.run_id, d.parent as from_id, d.child as to_id
from deps d join reach x on x.run_id = d.run_id and x.a = d.child and x.b = d.parent
join paths p on p.run_id = d.run_id and p.task_id = d.parent join paths q on q.run_id = d.run_id and q.task_id = d.child
where len(q.path) < len(p.path) or (len(q.path) = len(p.path) and q.path <= p.path)
"""


def _refs(name: str, row: str, ref: str, time: str) -> str:
    return f"select '{name}' as table_name, run_id, {clean(row)} as row_id, {clean(ref)} as ref_id, min({time}) as ref_time from {name} where {clean(ref)} is not null group by all"


def _parents(name: str, table: str, key: str, time: str, where: str = "true") -> str:
    return f"select '{name}' as table_name, run_id, {clean(key)} as ref_id, min({time}) as arrived, min(deleted_at) as deleted from {table} where {clean(key)} is not null and {where} group by all"


_ORPHANS = f"""
with refs as ({_refs('task_dependencies', 'task_id', 'depends_on', 'registered_at')}
  union all {_refs('graph_edges', 'edge_id', 'source_episode_id', 'recorded_at')}
  union all {_refs('claim_verifications', 'decision_id', 'claim_id', 'created_at')}),
parents as ({_parents('task_dependencies', 'tasks', 'task_id', 'registered_at')}
  union all {_parents('graph_edges', 'source_episodes', 'episode_id', 'retrieved_at')}
  union all {_parents('claim_verifications', 'graph_nodes', 'node_id', 'created_at', "node_type = 'Claim'")}),
found as (
  select r.*, case when p.ref_id is null then 'missing' when p.deleted <= r.ref_time then 'deleted' when p.arrived > r.ref_time then 'later' end as reason
  from refs r left join parents p on p.table_name = r.table_name and p.run_id = r.run_id and p.ref_id = r.ref_id)
"""

P5_FOUND = _ORPHANS + "select distinct table_name, run_id, row_id, ref_id from found where reason is not null"

P5_COUNTS = _ORPHANS + """
select table_name, run_id, strftime(ref_time, '%Y-%m') as period, reason, count(*) as orphans from found where reason is not null group by all
"""
