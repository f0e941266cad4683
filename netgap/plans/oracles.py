"""DuckDB SQL for the registered network queries, over the derived network (two-point edges)."""

from __future__ import annotations

from netgap.sources.testnet import SQL as NET

DIST = NET + """,
a as (select s,t,len from e union all select t,s,len from e),
dm(o,n,d) using key (o,n) as (
  select id,id,0e0 from nodes
  union
  select x.o,x.n,x.d from (select dm.o, a.t n, min(dm.d+a.len) d from dm join a on a.s=dm.n where dm.d+a.len<=1500 group by all) x
  left join recurring.dm k on k.o=x.o and k.n=x.n where k.d is null or x.d<k.d),
dist as (select o,n,cast(round_even(d,0) as integer) d from dm)
"""


def _on(px: str, py: str, g: str) -> tuple[str, str]:
    """Share t of segment ``g`` nearest to a point, and the distance."""
    dx, dy = f"({g}.x2-{g}.x1)", f"({g}.y2-{g}.y1)"
    t = f"least(greatest((({px}-{g}.x1)*{dx}+({py}-{g}.y1)*{dy})/({dx}*{dx}+{dy}*{dy}),0e0),1e0)"
    ex, ey = f"({px}-({g}.x1+{t}*{dx}))", f"({py}-({g}.y1+{t}*{dy}))"
    return t, f"sqrt({ex}*{ex}+{ey}*{ey})"


def _nearest() -> str:
    out = []
    for k, (px, py, g) in enumerate((("q.x1", "q.y1", "p"), ("q.x2", "q.y2", "p"), ("p.x1", "p.y1", "q"), ("p.x2", "p.y2", "q"))):
        t, d = _on(px, py, g)
        ap = f"{t}*p.len" if g == "p" else ("0e0" if k == 2 else "p.len")
        aq = f"{t}*q.len" if g == "q" else ("0e0" if k == 0 else "q.len")
        out.append(f"{{'d': {d}, 'k': {k}, 'ap': {ap}, 'aq': {aq}}}")
    return "list_min([" + ", ".join(out) + "])"


LINKS = DIST + f""",
nr as (select p.s fs, p.t ft, q.s ts, q.t tt, p.len lp, q.len lq, {_nearest()} m
  from e p join e q on (p.s < q.s or (p.s = q.s and p.t < q.t))
   and least(p.x1,p.x2)-100 <= greatest(q.x1,q.x2) and least(q.x1,q.x2) <= greatest(p.x1,p.x2)+100
   and least(p.y1,p.y2)-100 <= greatest(q.y1,q.y2) and least(q.y1,q.y2) <= greatest(p.y1,p.y2)+100),
pl as (select fs, ft, round_even(m.ap,0)::int f0, round_even(lp,0)::int - round_even(m.ap,0)::int f1,
  ts, tt, round_even(m.aq,0)::int t0, round_even(lq,0)::int - round_even(m.aq,0)::int t1, round_even(m.d,0)::int geo
  from nr where m.d <= 100),
fwd as (select pl.*, coalesce(least(d1.d+f0+t0, d2.d+f0+t1, d3.d+f1+t0, d4.d+f1+t1), 65535) net from pl
  left join dist d1 on d1.o=fs and d1.n=ts left join dist d2 on d2.o=fs and d2.n=tt
  left join dist d3 on d3.o=ft and d3.n=ts left join dist d4 on d4.o=ft and d4.n=tt),
links as (select * from fwd where net > 1000
  union all select ts,tt,t0,t1,fs,ft,f0,f1,geo,net from fwd where net > 1000)
"""
_LINK = "fs fr_src, ft fr_tgt, f0 fr_from_start, f1 fr_to_end, ts to_src, tt to_tgt, t0 to_from_start, t1 to_to_end, geo geo_m, net net_m"
_POINTS = """,
op as (select c_custkey k, (c_custkey%20)*80e0+15e0 x, (c_custkey//20)*80e0+15e0 y, 1e0+c_nationkey%5 w from customer),
dp as (select s_suppkey k, ((s_suppkey*7)%20)*80e0+10e0 x, s_suppkey*80e0-5e0 y, 1e0 w from supplier)
"""


def _weights(name: str, places: str, within: int) -> str:
    _, d = _on("p.x", "p.y", "g")
    return f""",
{name}n as (select p.k, p.w, g.s, g.t from {places} p join e g on {d} < {within}
   and p.x-{within} <= greatest(g.x1,g.x2) and least(g.x1,g.x2) <= p.x+{within} and p.y-{within} <= greatest(g.y1,g.y2) and least(g.y1,g.y2) <= p.y+{within}),
{name}c as (select k, 2*count(*) n from {name}n group by k),
{name} as (select id, sum(w/n) w from (select s id, w, n from {name}n join {name}c using (k) union all select t, w, n from {name}n join {name}c using (k)) group by id)
"""


def _score(decay: str) -> str:
    """``decay``: SQL with {d}."""
    return (
        LINKS
        + _POINTS
        + _weights("ow", "op", 20)
        + _weights("dw", "dp", 100)
        + f""",
ways as (select row_number() over () lid, * from links),
both_ as (select lid, 0 rv, * exclude (lid) from ways union all select lid, 1, ts,tt,t0,t1,fs,ft,f0,f1,geo,net from ways),
oe as (select lid, rv, geo, fs v, f0 off from both_ union all select lid, rv, geo, ft, f1 from both_),
te as (select lid, rv, geo, ts v, t0 off from both_ union all select lid, rv, geo, tt, t1 from both_),
od as (select lid, rv, geo, o, min(d+off) od, first(w) wo from oe join dist on n=v join ow on ow.id=o where w<>0 group by all having min(d+off) <= 1000-geo),
td as (select lid, rv, geo, o t, min(d+off) td, first(w) wt from te join dist on n=v join dw on dw.id=o where w<>0 group by all having min(d+off) <= 1000-geo),
trips as (select od.lid, od+od.geo+td nw, coalesce(d, 65535) old, wo, wt from od join td on od.lid=td.lid and od.rv=td.rv left join dist on dist.o=od.o and dist.n=td.t),
sc as (select lid, sum(({decay.format(d='nw')} - {decay.format(d='old')})*wo*wt) s from trips where nw < old group by lid),
scored as (select ways.*, round(coalesce(s,0e0),6) score from ways left join sc using (lid))
"""
    )


STEP = "(case when {d} < 1000 then 1e0 else 0e0 end)"
LINEAR = "(case when {d} < 1000 then 1e0 - {d}/1000e0 else 0e0 end)"
_COMPONENTS = NET + """,
a as (select s,t from e union all select t,s from e),
cc(id,l) using key (id) as (select id,id from nodes union
  select x.id,x.l from (select a.t id, min(cc.l) l from cc join a on a.s=cc.id group by a.t) x join recurring.cc k on k.id=x.id where x.l<k.l),
sz as (select l, count(*) n from cc group by l)
"""
_TILES = NET + """,
b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from nodes),
tiles as (select r, c, x0+(x1-x0)/3*c ax, x0+(x1-x0)/3*(c+1) bx, y0+(y1-y0)/3*r ay, y0+(y1-y0)/3*(r+1) by_ from b, range(3) q(r), range(3) w(c)),
core as (select id, r, c from nodes, tiles where x between ax-1100 and bx+1100 and y between ay-1100 and by_+1100),
te as (select distinct s, t, r, c from e join core on id = s or id = t)
"""
_T10, _D10 = _on("(g.x1+10e0)", "(g.y1+7e0)", "g")
_TP, _DP = _on("p.x", "p.y", "g")
_OUT = "round(w,9) w"

_LINES = NET + ", l as (select s*2 + case when t = s+1 then 0 else 1 end q, * from e)"


def _chains(name: str, nodes: str) -> str:
    """Chains that the vertices of ``nodes`` form with each other: id, l (smallest id)."""
    return f""",
{name}a as (select s, t from e where s in (select id from {nodes}) and t in (select id from {nodes}) union all select t, s from e where s in (select id from {nodes}) and t in (select id from {nodes})),
{name}(id,l) using key (id) as (select id, id from {nodes} union
  select x.id, x.l from (select a.t id, min(c.l) l from {name} c join {name}a a on a.s=c.id group by a.t) x join recurring.{name} k on k.id=x.id where x.l<k.l)"""


ORACLES: dict[str, str] = {
    "net_vertices": NET + "select row_number() over (order by id) as \"index\", 'v'||id as label, x, y from nodes",
    "net_edges": NET + ", c as (select id, row_number() over (order by id) k from nodes) select len length_m, lt link_type, 'v'||s src_label, 'v'||t tgt_label, a.k src_index, b.k tgt_index, x1, y1, x2, y2 from e join c a on a.id=s join c b on b.id=t",
    "edge_length": NET + "select s src, t dst, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) length_m from e",
    "edge_reverse": NET + "select s src, t dst, x2 x1, y2 y1, x1 x2, y1 y2 from e",
    "edge_first_last": NET + "select s src, t dst, x1 first_x, y1 first_y, x2 last_x, y2 last_y from e",
    "edge_envelope": NET + "select s src, t dst, least(x1,x2) min_x, least(y1,y2) min_y, greatest(x1,x2) max_x, greatest(y1,y2) max_y from e",
    "edge_wkt": NET + "select s src, t dst, 'LINESTRING ('||x1||' '||y1||', '||x2||' '||y2||')' wkt from e",
    "edge_break": NET + ", n as (select *, case when len > 30 then (floor(len/30e0)+1)::int else 1 end n from e), p as (select *, unnest(range(n)) k from n) select s src, t dst, k::int piece, case when k=0 then x1 else x1+(len*k/n)/len*(x2-x1) end x1, case when k=0 then y1 else y1+(len*k/n)/len*(y2-y1) end y1, case when k=n-1 then x2 else x1+(len*(k+1)/n)/len*(x2-x1) end x2, case when k=n-1 then y2 else y1+(len*(k+1)/n)/len*(y2-y1) end y2 from p",
    "edge_interpolate": NET + "select s src, t dst, x1+(len*0.25e0)/len*(x2-x1) x, y1+(len*0.25e0)/len*(y2-y1) y from e",
    "point_project": NET + f"select s src, t dst, {_D10} dist, {_T10}*len along from e g",
    "degree": NET + ", x as (select s id from e union all select t from e), c as (select id, count(*) n from x group by id) select id, coalesce(n,0) degree from nodes left join c using (id)",
    "dead_ends": NET + ", x as (select s id from e union all select t from e), c as (select id from x group by id having count(*)=1) select id, x, y from nodes join c using (id)",
    "extent": NET + "select min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from nodes",
    "components": _COMPONENTS + "select id, cc.l as label, n as size from cc join sz on sz.l=cc.l",
    "remove_islands": _COMPONENTS + "select s src, t dst, len length_m from e join cc on cc.id=s join sz on sz.l=cc.l where n >= 3",
    "dist_table": DIST + "select o origin, n dest, d from dist",
    "net_distance": DIST + ", p as (select g.s fs, g.t ft, round_even(g.len/2,0)::int f0, round_even(g.len,0)::int-round_even(g.len/2,0)::int f1, h.s ts, h.t tt, round_even(h.len/2,0)::int t0, round_even(h.len,0)::int-round_even(h.len/2,0)::int t1 from e g join e h on h.s = g.s+3 or (h.s=g.s and h.t=g.t)) select fs fr_src, ft fr_tgt, f0 fr_from_start, f1 fr_to_end, ts to_src, tt to_tgt, t0 to_from_start, t1 to_to_end, case when fs=ts and ft=tt then abs(f0-t0) else least(d1.d+f0+t0, d2.d+f0+t1, d3.d+f1+t0, d4.d+f1+t1) end::int net_m from p left join dist d1 on d1.o=fs and d1.n=ts left join dist d2 on d2.o=fs and d2.n=tt left join dist d3 on d3.o=ft and d3.n=ts left join dist d4 on d4.o=ft and d4.n=tt",
    "links_identify": LINKS + f"select {_LINK} from links",
    "links_reverse": LINKS + "select ts fr_src, tt fr_tgt, t0 fr_from_start, t1 fr_to_end, fs to_src, ft to_tgt, f0 to_from_start, f1 to_to_end, geo geo_m, net net_m from links",
    "links_table": LINKS
    + ", pt as (select l.*, case when f0<=0 then a.x1 when f0>=a.len then a.x2 else a.x1+f0/a.len*(a.x2-a.x1) end px, case when f0<=0 then a.y1 when f0>=a.len then a.y2 else a.y1+f0/a.len*(a.y2-a.y1) end py, case when t0<=0 then b.x1 when t0>=b.len then b.x2 else b.x1+t0/b.len*(b.x2-b.x1) end qx, case when t0<=0 then b.y1 when t0>=b.len then b.y2 else b.y1+t0/b.len*(b.y2-b.y1) end qy from links l join e a on a.s=fs and a.t=ft join e b on b.s=ts and b.t=tt) select 'v'||fs fr_src, 'v'||ft fr_tgt, 'v'||ts to_src, 'v'||tt to_tgt, case when net=65535 then 1e9 else net::double end network_length_m, geo::double geographic_length_m, px x1, py y1, qx x2, qy y2 from pt",
    "links_score_step": _score(STEP) + f"select {_LINK}, score from scored",
    "links_score_linear": _score(LINEAR) + f"select {_LINK}, score from scored",
    "links_topk": _score(STEP) + f"select {_LINK}, score, rk as rank from (select *, rank() over (order by score desc) rk from scored) where rk <= 5",
    "tile_vertices": _TILES + ", outer_ as (select s id, r, c from te union select t, r, c from te) select n.id, x, y, r::int tile_row, c::int tile_col from nodes n join (select id,r,c from core union select id,r,c from outer_) u on u.id=n.id",
    "tile_edges": _TILES + "select te.s src, te.t dst, e.len length_m, e.lt link_type, r::int tile_row, c::int tile_col from te join e on e.s=te.s and e.t=te.t",
    "tile_links_merged": _score(STEP) + "select fs fr_src, ft fr_tgt, f0 fr_from_start, f1 fr_to_end, ts to_src, tt to_tgt, t0 to_from_start, t1 to_to_end, geo geo_m, 0 net_m, score from scored where (fs,ft,f0,f1) <= (ts,tt,t0,t1)",
    "weights_points": NET + _POINTS + _weights("ow", "op", 20) + f"select nodes.id, {_OUT.replace('w,9', 'coalesce(w,0e0),9')} from nodes left join ow using (id)",
    "weights_coverage": NET + _POINTS + _weights("ow", "op", 20) + "select round((select sum(w) from ow)/(select sum(w) from op),9) coverage",
    "weights_partition": _TILES + _POINTS + _weights("ow", "op", 20) + f", mine as (select id from core where r=0 and c=0 union select s from te where r=0 and c=0 union select t from te where r=0 and c=0) select mine.id, {_OUT.replace('w,9', 'coalesce(w,0e0),9')} from mine left join ow using (id)",
    "nearest_edge": NET + _POINTS + f", z as (select p.k, {_DP} dist, g.s, g.t, {_TP}*g.len along, g.len from op p join e g on p.x-100 <= greatest(g.x1,g.x2) and least(g.x1,g.x2) <= p.x+100 and p.y-100 <= greatest(g.y1,g.y2) and least(g.y1,g.y2) <= p.y+100), f as (select *, row_number() over (partition by k order by dist, s, t) rk from z where dist <= 100) select k, s src, t dst, dist, along from_start, len-along from_end from f where rk=1",
    "route_distance": NET
    + f""", pts(k,x,y) as (values (0, 20e0, 30e0), (1, 1200e0, 500e0)),
z as (select p.k, {_DP} dist, g.s, g.t, {_TP}*g.len along, g.len from pts p join e g on true),
f as (select *, row_number() over (partition by k order by dist, s, t) rk from z), sn as (select * from f where rk=1),
a as (select s,t,len from e union all select t,s,len from e),
rt(n,d) using key (n) as (select n, d from (select s n, along d from sn where k=0 union all select t, len-along from sn where k=0)
 union select x.n,x.d from (select a.t n, min(rt.d+a.len) d from rt join a on a.s=rt.n group by a.t) x left join recurring.rt q on q.n=x.n where q.d is null or x.d<q.d)
select round(min(d + case when n=s then along else len-along end),6) distance from sn join rt on n=s or n=t where k=1""",
    "distance_surface": DIST
    + f""", og as (select 400e0 x, 300e0 y), gr as (select (i//41)::bigint "row", (i%41)::bigint col, -600e0+(i%41)*50e0 x, 1300e0-(i//41)*50e0 y from range(41*41) r(i)),
z0 as (select {_DP} dist, g.s, g.t, {_TP}*g.len along, g.len from og p, e g), s0 as (select * from z0 order by dist, s, t limit 1),
z as (select p."row", p.col, {_DP} dist, g.s, g.t, {_TP}*g.len along, g.len from gr p join e g on p.x-100 <= greatest(g.x1,g.x2) and least(g.x1,g.x2) <= p.x+100 and p.y-100 <= greatest(g.y1,g.y2) and least(g.y1,g.y2) <= p.y+100),
f as (select *, row_number() over (partition by "row", col order by dist, s, t) rk from z where dist <= 100),
rc as (select n, min(dd) d from (select n, d+along dd from s0 join dist on o=s union all select n, d+(len-along) from s0 join dist on o=t) group by n),
th as (select f."row", f.col, case when f.s=(select s from s0) and f.t=(select t from s0) then abs(f.along-(select along from s0)) else least(a.d+f.along, b.d+(f.len-f.along)) end + f.dist + (select dist from s0) v from f left join rc a on a.n=f.s left join rc b on b.n=f.t where f.rk=1)
select gr."row", gr.col, x, y, coalesce(round_even(v,0),65535e0) "value" from gr left join th on th."row"=gr."row" and th.col=gr.col""",
    "realize_edges": LINKS
    + """, lk as (select * from links where fs < ts), st as (select fs s, ft t, f0 o from lk union select ts, tt, t0 from lk),
ho as (select st.*, round_even(len,0)::int l from st join e on e.s=st.s and e.t=st.t), mx as (select max(id) m from nodes),
mk as (select s, t, o, m + row_number() over (order by s,t,o) id from ho, mx where o > 0 and o < l),
nm as (select s,t,o,id from mk union all select s,t,o,s from ho where o<=0 union all select s,t,o,t from ho where o>=l and o>0),
sp as (select s, t, o::double pos, id from mk union all select e.s, e.t, 0e0, e.s from e where exists (select 1 from mk where mk.s=e.s and mk.t=e.t)
  union all select e.s, e.t, e.len, e.t from e where exists (select 1 from mk where mk.s=e.s and mk.t=e.t)),
sq as (select s, t, id a, lead(id) over w b, lead(pos) over w - pos len from sp window w as (partition by s, t order by pos)),
ed as (select least(a,b) src, greatest(a,b) dst, len length_m, lt link_type from sq join (select s s0, t t0, lt from e) k on k.s0=s and k.t0=t where b is not null
  union all select s, t, len, lt from e where not exists (select 1 from mk where mk.s=e.s and mk.t=e.t)),
ne as (select least(a.id,b.id) src, greatest(a.id,b.id) dst, arg_min(geo, (fs,ft,f0,ts,tt,t0))::double length_m from lk join nm a on a.s=fs and a.t=ft and a.o=f0 join nm b on b.s=ts and b.t=tt and b.o=t0 where a.id<>b.id group by 1,2)
select * from ed union all select src, dst, length_m, 'candidate' from ne where not exists (select 1 from ed where ed.src=ne.src and ed.dst=ne.dst)""",
    "osm_traversable": """select p_partkey as id, coalesce((p_size%5=2) or ((p_size%3=0) and not (p_size%4=1)), false) as walkable from part""",
    "osm_traversable_rules": """select p_partkey as id, case when p_size%5=2 then true when p_size%4=1 then false when p_size%3=0 then true else false end as walkable from part""",
    "tntp_body": NET + ", c as (select id, row_number() over (order by id) k from nodes) select a.k init_node, b.k term_node, null::double capacity, len length, null::double free_flow_time, null::double b, null::double power, null::double speed_limit, null::double toll, lt link_type from e join c a on a.id=s join c b on b.id=t",
    "snap_vertices": _LINES + ", p as (select q*2 seq, x1 x, y1 y from l union all select q*2+1, x2, y2 from l), f as (select x, y, min(seq) m from p group by x, y), i as (select x, y, row_number() over (order by m) id from f) select seq, id from p join i using (x, y)",
    "build_from_layers": _LINES
    + """, n as (select *, case when len > 50 then (floor(len/50e0)+1)::int else 1 end n from l), p as (select *, unnest(range(n)) k from n),
z as (select q, k, lt, case when k=0 then x1 else x1+(len*k/n)/len*(x2-x1) end ax, case when k=0 then y1 else y1+(len*k/n)/len*(y2-y1) end ay,
  case when k=n-1 then x2 else x1+(len*(k+1)/n)/len*(x2-x1) end bx, case when k=n-1 then y2 else y1+(len*(k+1)/n)/len*(y2-y1) end by_ from p),
f as (select x, y, row_number() over (order by min(o)) id from (select ax x, ay y, (q,k,0) o from z union all select bx, by_, (q,k,1) from z) group by x, y)
select least(a.id,b.id) src, greatest(a.id,b.id) dst, sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)) length_m, lt link_type from z join f a on a.x=ax and a.y=ay join f b on b.x=bx and b.y=by_""",
    "collapse": NET
    + ", d as (select id from (select s id from e union all select t from e) group by id having count(*)=2)"
    + _chains("c1", "d")
    + """,
en as (select l, t corner from e join c1 on id=s where t not in (select id from d) union all select l, s from e join c1 on id=t where s not in (select id from d)),
kd as (select l, mx, a, b from (select l, max(id) mx from c1 group by l) left join (select l, min(corner) a, max(corner) b from en group by l) using (l)),
fi as (select a, b, min(mx) f from kd where a<b group by a, b),
kp as (select kd.l, case when kd.a is null then 3 when kd.a=kd.b then 2 when mx>f or exists (select 1 from e where e.s=kd.a and e.t=kd.b) then 1 else 0 end kp from kd left join fi on fi.a=kd.a and fi.b=kd.b),
st as (select id from (select id, l, row_number() over (partition by l order by id desc) r from c1) join kp using (l) where r<=kp),
d2 as (select id from d where id not in (select id from st))"""
    + _chains("c2", "d2")
    + """,
sg as (select coalesce(p.l,q.l) g, e.* from e left join c2 p on p.id=e.s left join c2 q on q.id=e.t),
ct as (select g, min(id) a, max(id) b from (select g, id from (select g, s id from sg union all select g, t from sg) where g is not null group by g, id having count(*)=1) group by g)
select a src, b dst, round(sum(len),6) length_m, string_agg(distinct lt, '|' order by lt) link_type, (count(*)+1)::int points from sg join ct using (g) group by g, a, b
union all select s, t, round(len,6), lt, 2 from sg where g is null""",
}
