"""DuckDB SQL of the queries that SQL can express: rules, vectors, mixing and near copies."""

from __future__ import annotations

from quillpanel.llm import cosine, minhash, mixing, repair, resampling, rules, templates

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: node and smallest node reachable over the links (a, b), given in both directions.
REACHABLE = """
reach(node, other) as (
  select distinct a, a from links
  union
  select r.node, l.b from reach r join links l on l.a = r.other
),
components as (select node, min(other) as component from reach group by node)
"""


def rules_sql() -> str:
    """The figures, then one query step for each round of the estimation."""
    names = [r.name for r in rules.RULES]
    without = lambda column, characters: f"length(translate({column}, {characters}, ''))"
    steps = [
        f"""d as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents),
w as (select row, doc_id, text, {WORDS.format("text")} as w, list_filter(string_split(text, chr(10)), lambda x: translate(x, {SPACES}, '') <> '') as l from d),
triples as (
  select row, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as t
  from (select row, w, unnest(range(1, len(w) - 1)) as k from w)
),
twice as (select row, k from (select *, count(*) over (partition by row, t) as n from triples) where n > 1),
covered as (select row, count(distinct p) as n from (select row, unnest([k, k + 1, k + 2]) as p from twice) group by row),
f as (
  select w.doc_id, len(w)::bigint as n_words, {without("text", SPACES)}::bigint as word_chars,
    (length(text) - {without("text", f"'{rules.SYMBOLS}'")})::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::bigint as n_capitals,
    length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'))::bigint as n_marks,
    (length(text) - {without("text", "'.!?'")})::bigint as n_stops
  from w left join covered c using (row)
),
v as (select *, {", ".join(f"{r.sql} as {r.name}" for r in rules.RULES)} from f),
patterns as materialized (select {", ".join(names)}, count(*) as n from v group by all)"""
    ]
    first = rules.start(rules.RULES)
    values = [f"{first.prior}::double as prior"]
    for i in range(len(names)):
        values += [f"{x}::double as {c}{i}" for c, x in zip(("gg", "gb", "bg", "bb"), (*first.on_good[i], *first.on_bad[i]), strict=True)]
    steps.append(f"e0 as (select {', '.join(values)})")
    odds = "ln(prior / (1 - prior)) + " + " + ".join(
        f"case {n} when 1 then ln(gg{i} / bg{i}) when -1 then ln(gb{i} / bb{i}) else ln((1 - gg{i} - gb{i}) / (1 - bg{i} - bb{i})) end" for i, n in enumerate(names)
    )
    right = lambda s, of: f"least({rules.MOST}, greatest({rules.LEAST}, (coalesce({s}, 0) + {rules.PSEUDO * rules.RIGHT}) / ({of} + {rules.PSEUDO})))"
    wrong = lambda s, of, there: f"least(greatest({rules.LEAST / 2}, (coalesce({s}, 0) + {rules.PSEUDO * rules.WRONG}) / ({of} + {rules.PSEUDO})), {rules.WORST} * {there})"
    for k in range(1, rules.ITERATIONS + 1):
        sums = [f"sum({c}) filter ({n} = {v}) as {c}{s}{i}" for i, n in enumerate(names) for c in "gb" for v, s in ((1, "g"), (-1, "b"))]
        steps.append(
            f"s{k} as (select sum(g) as g, sum(b) as b, {', '.join(sums)} from "
            f"(select *, n - g as b from (select p.*, n / (1 + exp(-({odds}))) as g from patterns p cross join e{k - 1})))"
        )
        prior = f"least({rules.PRIOR_HIGH}, greatest({rules.PRIOR_LOW}, (g + {rules.PSEUDO * rules.PRIOR}) / (g + b + {rules.PSEUDO})))"
        new = []
        for i in range(len(names)):
            good, bad = right(f"gg{i}", "g"), right(f"bb{i}", "b")
            new += [f"{good} as gg{i}", f"least({wrong(f'gb{i}', 'g', bad)}, 0.99 - {good}) as gb{i}"]
            new += [f"least({wrong(f'bg{i}', 'b', good)}, 0.99 - {bad}) as bg{i}", f"{bad} as bb{i}"]
        steps.append(f"e{k} as materialized (select {prior} as prior, {', '.join(new)} from s{k})")
    return f"""with {", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and quality >= {rules.KEEP} as kept, round(quality, 6) as quality
from (select v.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1 / (1 + exp(-({odds}))) as quality from v cross join e{rules.ITERATIONS})"""


VECTORS = f"""with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n as (select *, sqrt(list_dot_product(e, e)) as norm from v),
links as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {cosine.THRESHOLD}
),
{REACHABLE}
select m.vec_id, (select count(*) from links l where l.a = m.vec_id) as n_links, coalesce(c.component, m.vec_id) as component_id,
  coalesce(c.component, m.vec_id) = m.vec_id as kept
from embeddings m left join components c on c.node = m.vec_id"""

NEAR_COPIES = f"""with recursive w as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
s as (
  select distinct doc_id, array_to_string(w[k : k + {minhash.SHINGLE - 1}], ' ') as t
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {minhash.SHINGLE - 2}, 2))) as k from w where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {minhash.PERCENT} * (x.n + y.n - c)),
{REACHABLE}
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component, d.doc_id) as component_id, coalesce(c.component, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join components c on c.node = d.doc_id"""


def mixing_sql() -> str:
    """Targets, draws, what is drawn again, permutation rounds and the join of slots with blocks."""
    p, seed, block, slots = mixing.PRIME, mixing.SEED, mixing.BLOCK, mixing.SHARD_SLOTS
    weights = ", ".join(f"{float(w)}" for w in mixing.WEIGHTS)

    def hashing(name: str, source: str, value: str, salt: str, out: str) -> str:
        return f"""{name}a as (select *, ({value} * 48271 + {salt}) % {p} as h_a from {source}),
{name}b as (select *, (h_a * h_a + {salt}) % {p} as h_b from {name}a),
{name}c as (select *, (h_b * h_b + h_a) % {p} as h_c from {name}b),
{name} as (select * exclude (h_a, h_b, h_c), (h_c * 69621 + h_b) % {p} as {out} from {name}c)"""

    def turns(name: str, keep: str) -> str:
        """Rounds from ``name``0 (place, n, key and ``keep``) to ``name`` and the number of rounds."""
        out = []
        for r in range(1, mixing.ROUNDS + 1):
            a, b, s = mixing._round(r)
            out.append(f"""{name}o{r} as (select *, (key * {a} + {b} + n - place) % n as other, (key + {s}) % {p} as salt from {name}{r - 1}),
{hashing(f"{name}m{r}", f"{name}o{r}", "greatest(place, other)", "salt", "mark")},
{name}{r} as (select {keep}, n, key, case when mark & 1024 <> 0 then other else place end as place from {name}m{r})""")
        return ", ".join(out)

    running = "rows between unbounded preceding and 1 preceding"
    return f"""with d as (select doc_id, source, len({WORDS.format("coalesce(text, '')")})::bigint as size from documents),
totals as (select source, count(*) as n_docs, sum(size)::bigint as source_size from d group by source),
ranked as (select *, row_number() over (order by source asc nulls last) as k from totals),
weighed as (select *, list_extract([{weights}]::double[], (k - 1) % {len(mixing.WEIGHTS)} + 1) as weight, source_size * {float(mixing.MOST)} as cap from ranked),
levels as (
  select *, ((select sum(source_size) from weighed) * {mixing.SHARE} - coalesce(sum(cap) over before, 0)) / ((select sum(weight) from weighed) - coalesce(sum(weight) over before, 0)) as level
  from weighed window before as (order by cap / weight, k rows between unbounded preceding and 1 preceding)
),
targets as (select k, source, n_docs, source_size, round(least(cap, (select max(level) from levels) * weight), 6) as target from levels),
blocks as (select *, ceil(source_size / {block})::bigint as n_blocks from targets where source_size > 0),
wanted as materialized (
  select *, row_number() over (order by k) as no, sum(wanted) over (order by k)::bigint as upto, sum(wanted) over ()::bigint as slots
  from (select k, n_blocks, round(target * n_blocks / source_size)::bigint as wanted from blocks) where wanted > 0
),
bounds as (select list(floor(upto / slots::double * {p})::bigint order by no) as bounds, max(slots) as slots, count(*) as sources from wanted),
shards as (select *, unnest(range(0, (slots - 1) // {slots} + 1)) as shard from bounds),
each as (select bounds, sources, shard, ({seed} + shard * 7919) % {p} as salt, unnest(range(least({slots}, slots - shard * {slots}))) as slot from shards),
{hashing("number", "each", "slot", "salt", "u")},
drawn as materialized (select shard, least(sources, len(list_filter(bounds, lambda b: b <= u)) + 1) as no, count(*) as count from number group by all),
owed as materialized (
  select *, sum(less) over (order by no)::bigint as lacking from (
    select w.no, coalesce(g.got, 0)::bigint as got, greatest(0, coalesce(g.got, 0) - wanted)::bigint as more, greatest(0, wanted - coalesce(g.got, 0))::bigint as less
    from wanted w left join (select no, sum(count) as got from drawn group by no) g using (no)
  )
),
counted as (select *, coalesce(sum(count) over (partition by no order by shard {running}), 0)::bigint as ahead from drawn join (select no, got, more from owed where more > 0) using (no)),
given as (select * from (select shard, no, (floor(more * ((ahead + count) / got::double)) - floor(more * (ahead / got::double)))::bigint as given from counted) where given > 0),
void as (select *, coalesce(sum(void) over (order by shard {running}), 0)::bigint as ahead from (select shard, sum(given)::bigint as void from given group by shard)),
again0 as (
  select shard, bounds, n, ({seed} % {p})::bigint as key, unnest(range(ahead, ahead + void)) as place
  from void, (select max(lacking) as n, list(lacking order by no) as bounds from owed)
),
{turns("again", "shard, bounds")},
changes as (
  select shard, len(list_filter(bounds, lambda b: b <= place)) + 1 as no, count(*) as count from again{mixing.ROUNDS} group by all
  union all select shard, no, -given from given union all select shard, no, count from drawn
),
counts as (select w.k, w.n_blocks, c.* from (select shard, no, sum(count)::bigint as count from changes group by all) c join wanted w using (no) where count > 0),
numbered as (select *, coalesce(sum(count) over (partition by k order by shard {running}), 0)::bigint as first from counts),
slots as (select k, n_blocks, unnest(range(first, first + count)) as i from numbered),
take0 as (select k, n_blocks as n, ({seed} + k * 104729 + (i // n_blocks) * 1299709) % {p} as key, i % n_blocks as place from slots),
{turns("take", "k")},
taken_blocks as (select k, place as block, count(*) as times from take{mixing.ROUNDS} group by all),
placed as (
  select *, coalesce(sum(size) over (partition by k order by bucket, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from (select d.*, t.k, t.source_size, t.target, coalesce(d.doc_id, 0) % ceil(t.n_docs / {mixing.BUCKET_DOCS})::bigint as bucket, row_number() over () as row
        from d join targets t on d.source is not distinct from t.source)
),
parts as (select row, k, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) as block from placed where size > 0),
taken as (
  select row, sum((least(start + size, (p.block + 1) * {block}) - greatest(start, p.block * {block})) * times)::bigint as taken
  from parts p join taken_blocks w on w.k = p.k and w.block = p.block group by row
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from placed left join taken using (row)"""


#: The table of CRC-32, from its polynomial.
CRC_TABLE = "crc_table as materialized (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc)"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, where column ``crc`` holds the table."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def templates_sql() -> str:
    """Rules, shapes, then one query step for each level of the tree."""
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    longest_first = sorted(templates.RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    pick = lambda of: "case " + " ".join(f"when {fits(r)} then '{of(r)}'" for r in longest_first) + " end"
    names = [k for k, _ in templates.KINDS] + ["other"]
    kind = "case " + " ".join(f"when regexp_matches(next, '{p}') then '{k}'" for k, p in templates.KINDS) + " else 'other' end"
    near = lambda part, whole: f"abs({part} / {whole} - all_{part} / all_{whole}) <= {templates.SPREAD} * (1 / sqrt({whole}) + 1 / sqrt(all_{whole}))"
    counted = lambda k: f"sum(case when kind = '{k}' then n else 0 end) as k_{k}"
    lead = "case " + " ".join(f"when k_{k} = greatest({', '.join(f'k_{x}' for x in names)}) then '{k}'" for k in names) + " end"
    figures = ["branch_n", *[f"k_{k}" for k in names], "blocked", "labelled"]
    steps = []
    for at in range(1, templates.LEVELS + 2):
        steps.append(f"""g{at} as (select *, {kind} as kind from (select *, parts[{at}] as branch, coalesce(parts[{at + 1}], '') as next from r{at - 1} where len(parts) >= {at})),
b{at} as (
  select *, {lead} as lead from (
    select host, template, branch, sum(n) as branch_n, {", ".join(map(counted, names))}, sum(blocked) as blocked, sum(blocked + allowed) as labelled from g{at} group by all
  )
),
m{at} as (
  select *, {", ".join(f"sum({c}) over of_lead as all_{c}" for c in figures)}, count(*) over of_lead as of_, sum(branch_n) over node as node_n, count(*) over node as node_of
  from b{at} window node as (partition by host, template), of_lead as (partition by host, template, lead)
),
t{at} as (
  select host, template, branch, case when node_of > {templates.MANY} and branch_n * {templates.MANY} < node_n then '*'
    when of_ > 1 and (labelled = 0 or {near("blocked", "labelled")}) and {" and ".join(near(f"k_{k}", "branch_n") for k in names)} then '+' || lead else branch end as token
  from m{at}
),
r{at} as materialized (
  select host, parts, n, blocked, allowed, template || '/' || token as template from g{at} join t{at} using (host, template, branch)
  union all select * from r{at - 1} where len(parts) < {at}
)""")
    return f"""with urls as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
d as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from urls),
j as (
  select *, {pick(lambda r: r.text)} as rule, {pick(lambda r: r.verdict)} as by_rule,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') as cut from d
),
p as (select * exclude (cut), case when len(cut) > {templates.LEVELS} then list_append(cut[1:{templates.LEVELS}], '**') else cut end as parts from j),
r0 as (select host, parts, count(*) as n, count(*) filter (by_rule = 'block') as blocked, count(*) filter (by_rule = 'allow') as allowed, '' as template from p group by host, parts),
{", ".join(steps)},
leaves as (select * from r{templates.LEVELS + 1}),
share as (select coalesce(sum(blocked) / nullif(sum(blocked + allowed), 0), 0) as share from leaves),
bad as (
  select host, template from leaves, share group by host, template, share
  having sum(blocked) > 0 and (sum(blocked) + {templates.PSEUDO} * share) / (sum(blocked + allowed) + {templates.PSEUDO}) >= {templates.REJECT}
)
select p.page_id, p.host, p.path, p.rule, coalesce(p.by_rule, case when b.host is null then 'allow' else 'block' end) as verdict, l.template
from p join leaves l on l.host = p.host and l.parts = p.parts left join bad b on b.host = l.host and b.template = l.template"""


def repair_sql() -> str:
    """Damage and faults, costs from each conversation's end, then the walk along them; lists start at 1."""
    r = repair
    trimmed = f"rtrim(text, {SPACES})"
    never = 1 << 40
    own = [  # before inserts, by state
        f"least({r.DELETE} + v[1], keep + case letter when 's' then v[2] when 'u' then v[3] else {never} end, keep + {r.REROLE} + v[3])",
        f"least({r.DELETE} + v[2], keep + case letter when 'u' then v[3] else {never} end, keep + {r.REROLE} + v[3])",
        f"least({r.DELETE} + v[3], keep + case letter when 'a' then v[4] else {never} end, keep + {r.REROLE} + v[4])",
        f"least({r.DELETE} + v[4], keep + case letter when 'u' then v[3] else {never} end, keep + {r.REROLE} + v[3])",
    ]
    best = f"[least(o[1], {r.INSERT} + o[3], {2 * r.INSERT} + o[4]), least(o[2], {r.INSERT} + o[3], {2 * r.INSERT} + o[4]), least(o[3], {r.INSERT} + o[4]), least(o[4], {r.INSERT} + o[3])]"
    fits = "case when letter = 's' and s = 1 then 2 when letter = 'u' and s <> 3 then 3 when letter = 'a' and s = 3 then 4 end"
    faults = ("blank", "duplicate", "truncated")
    return f"""with recursive {CRC_TABLE},
source as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as mark from conversations, crc_table
),
d as (
  select dense_rank() over (order by conv_id) as c, conv_id, turn, case mark when 4 then 'user' else role end as role,
    case mark when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case mark when 3 then 2 else 1 end)) as copy
  from source where mark <> 0
),
o as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i, substr(role, 1, 1) as letter from d),
n as (select *, row_number() over (partition by c, role, text order by i) as nth from o),
f as (
  select *, case when {trimmed} = '' then 'blank' when nth > 1 then 'duplicate' when right({trimmed}, 1) not in ('.', '!', '?') then 'truncated' end as fault,
    lag(letter) over (partition by c order by i) as previous from n
),
k as materialized (select c, i, letter, role, text, case fault when 'truncated' then {r.TRUNCATED} when 'blank' then {never} when 'duplicate' then {never} else 0 end as keep from f),
lengths as materialized (
  select c, any_value(conv_id) as conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    {", ".join(f"count(*) filter (fault = '{x}') as {x}" for x in faults)}, count(*) filter (i > 1 and previous || letter not in ('su', 'ua', 'au')) as illegal
  from f group by c
),
back(c, i, v) as (
  select c, n + 1, {list(r.END)}::bigint[] from lengths
  union all
  select c, i, {best} from (select k.c, k.i, [{", ".join(own)}]::bigint[] as o from back b join k on k.c = b.c and k.i = b.i - 1)
),
costs as materialized (select * from back),
walk(c, i, s, audit, lines) as (
  select c, 1::bigint, 1, '', []::varchar[] from lengths
  union all
  select c, case e when 'I' then i else i + 1 end, case e when 'D' then s when 'K' then fit else forced end, audit || e,
    case e when 'D' then lines when 'I' then list_append(lines, required || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, required || ':' || text) end
  from (
    select *, case forced when 3 then 'user' else 'assistant' end as required, case when {r.DELETE} + after[s] = here[s] then 'D' when {r.INSERT} + here[forced] = here[s] then 'I'
      when keep + after[fit] = here[s] then 'K' when keep + {r.REROLE} + after[forced] = here[s] then 'R' end as e
    from (
      select w.*, k.letter, k.role, k.text, k.keep, h.v as here, a.v as after, case s when 3 then 4 else 3 end as forced, {fits} as fit
      from walk w join lengths l on l.c = w.c join costs h on h.c = w.c and h.i = w.i
        left join costs a on a.c = w.c and a.i = w.i + 1 left join k on k.c = w.c and k.i = w.i
      where not (w.i > l.n and w.s in (1, 4))
    )
  )
),
done as (
  select l.*, w.audit, w.lines, h.v[1] as cost from walk w join lengths l on l.c = w.c and w.i = l.n + 1 join costs h on h.c = w.c and h.i = 1 where w.s in (1, 4)
)
select a.conv_id, {", ".join(f"coalesce(d.{x}, 0)::bigint as {x}" for x in ("gaps", *faults, "illegal", "cost"))},
  coalesce(d.audit, '') as audit, sha256(coalesce(array_to_string(d.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join done d on a.conv_id is not distinct from d.conv_id"""


RESAMPLING = f"""with {CRC_TABLE},
own as (
  select doc_id, row_number() over () as row,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
),
other as (
  select list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
),
own_words as materialized (select row, word, count(*) as n from (select row, unnest(w) as word from own) group by all),
other_words as (select word, count(*) as n from (select unnest(w) as word from other) group by all),
hashed as materialized (select word, {crc32("word")} % {resampling.BUCKETS} as bucket from (select word from own_words union select word from other_words), crc_table),
s as (select bucket, sum(n) as s from own_words join hashed using (word) group by bucket),
t as (select bucket, sum(n) as t from other_words join hashed using (word) group by bucket),
totals as (select coalesce((select sum(s) from s), 0)::double as all_s, coalesce((select sum(t) from t), 0)::double as all_t),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (all_s + {resampling.BUCKETS}) / ((s::double + 1) * (all_t + {resampling.BUCKETS}))))::bigint as gain
  from s left join t using (bucket), totals
),
weights as (select row, sum(n) as n, sum(n * gain) as total from own_words join hashed using (word) join gains using (bucket) group by row),
scores as (
  select doc_id, row, coalesce(n, 0)::bigint as n_features, coalesce(floor(total::double / n), 0)::bigint as weight,
    ('0x' || substr(sha256(concat('{resampling.SEED}:', doc_id)), 1, 8))::bigint as h
  from own left join weights using (row)
),
final as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scores),
able as (select row, row_number() over (order by score desc, doc_id asc nulls last, n_features) as rank, count(*) over () as n from final where n_features >= {resampling.LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= floor({resampling.PERCENT} * n / 100) then rank end as rank from final left join able using (row)"""


ORACLES: dict[str, str] = {
    "op4_rules": rules_sql(),
    "op5_cosine": VECTORS,
    "op8_mixing": mixing_sql(),
    "op10_minhash": NEAR_COPIES,
    "op11_templates": templates_sql(),
    "op12_repair": repair_sql(),
    "op13_resampling": RESAMPLING,
}
