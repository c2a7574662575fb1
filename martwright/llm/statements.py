"""Expected results of the queries that SQL can express, for DuckDB."""

# Fixed values of the contract: the blanks stripped from lines, A to Z.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
with split as (
  select doc_id, row_number() over () as row_no, string_split(coalesce(text, ''), chr(10)) as lines
  from documents
),
lines as (
  select doc_id, row_no, unnest(lines) as line, unnest(range(len(lines))) as position from split
),
keyed as (select *, translate(trim(line, {BLANKS}), {LOWERED}) as key from lines),
frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines,
       count(*) filter (where key in (select key from frequent)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by position)
                       filter (where key not in (select key from frequent)), '')) as kept_sha256
from keyed group by doc_id, row_no
"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
with digits as (
  select page_id, html,
         array_to_string(list_transform(range(4), lambda i:
           lpad(to_base(('0x' || substr(sha1(coalesce(html, '')), (1 + 10 * i)::bigint, 10))::bigint,
                        32), 8, '0')), '') as base
  from pages
),
pages_read as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
         translate(base, '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{BASE32}') as payload_digest
  from digits
),
first as (
  select payload_digest, min(page_id) as response from pages_read group by payload_digest
)
select page_id, payload_bytes, payload_digest,
       case when page_id is not distinct from response then 'response' else 'revisit' end
         as record_type,
       case when page_id is distinct from response then response end as refers_to
from pages_read join first using (payload_digest)
"""



def _tree(name: str, first: str, depth: int) -> str:
    """Levels of a Merkle tree: nodes {name}0 to {name}{depth} and siblings {name}x0 onwards.

    ``first`` selects grp, pos and node. A lone node is kept as it is, so levels beyond the last
    change nothing.
    """
    parts = [f"{name}0 as (select *, count(*) over (partition by grp) as n from ({first}))"]
    for k in range(depth):
        own, above = f"{name}{k}", f"{name}{k + 1}"
        parts.append(f"""
{name}x{k} as (
  select a.grp, a.pos, any_value(a.n) as n,
         coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
         coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from {own} a join {own} b on a.grp is not distinct from b.grp and a.pos // 16 = b.pos // 16
  group by a.grp, a.pos
),
{above} as (
  select *, count(*) over (partition by grp) as n from (
    select grp, pos // 16 as pos,
           case when n = 1 then any_value(node) else sha256(string_agg(node, '' order by pos)) end
             as node
    from {own} group by grp, pos // 16, n
  )
)""")
    return ",".join(parts)


def _merkle(depth: int = 4, top: int = 2) -> str:
    field = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = field.format(f"translate(text, {LOWERED})")
    bits = "list_transform(range(8), lambda i: i)"
    crc = f"""list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), {bits}),
        lambda d, i: case when d % 2 = 1 then xor(d // 2, 3988292384) else d // 2 end))"""
    steps = [f"s{k}" for k in range(depth)] + [f"t{k}" for k in range(top)]
    joins = "\n".join(
        f"join ax{k} s{k} on s{k}.grp is not distinct from o.source and s{k}.pos = o.pos // {16**k}"
        for k in range(depth)
    ) + "\n" + "\n".join(
        f"join bx{k} t{k} on t{k}.pos = g.pos // {16**k}" for k in range(top)
    )
    siblings = " || ".join(f"{s}.l || {s}.r" for s in steps)
    start = "case when o.tampered then o.changed else o.leaf end"
    # Folded step by step in a subquery each, as the nested text would double with every step.
    folds, last = [], "f0"
    folds.append(f"""f0 as (
  select o.doc_id, o.leaf, g.node as subroot, {start} as acc, sha256({siblings}) as proof_sha256,
         {", ".join(f"{s}.l as {s}l, {s}.r as {s}r, {s}.n as {s}n" for s in steps)}
  from ordered o join groups g on g.grp is not distinct from o.source
  {joins}
)""")
    for i, s in enumerate(steps):
        folds.append(f"""f{i + 1} as (
  select * replace (case when {s}n = 1 then acc else sha256({s}l || acc || {s}r) end as acc)
  from {last}
)""")
        last = f"f{i + 1}"
    return f"""
with ordered as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos
  from (
    select doc_id, source, sha256({head} || {field.format("text")}) as leaf,
           sha256({head} || {lowered}) as changed,
           doc_id is not null and xor({crc}, 4294967295) % 5 = 0 as tampered
    from documents
  )
),
{_tree("a", "select source as grp, pos, leaf as node from ordered", depth)},
groups as (
  select grp, row_number() over (order by grp nulls first) - 1 as pos, node from a{depth}
),
{_tree("b", "select 0 as grp, pos, node from groups", top)},
{", ".join(folds)}
select doc_id, leaf, subroot, b{top}.node as root, proof_sha256, acc as folded_root,
       acc = b{top}.node as verified
from {last}, b{top}
"""


MERKLE = _merkle()

# The length of a formatted conversation depends on the template's frames, so it is stated here.
CONTROL = "[\\[<]\\\\*(INST\\]|/INST\\]|s>|/s>|<SYS>>|</SYS>>|ROLE\\]|SAYS\\]|/ROLE\\])"

CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)
),
sized as (
  select *,
         length(text) + len(regexp_extract_all(text, '{CONTROL}'))
           + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 7
             else length(role) + len(regexp_extract_all(role, '{CONTROL}')) + 21 end as formatted
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
                       filter (role = 'assistant'), '')) as loss_sha256,
       sum(formatted)::bigint as formatted_chars
from sized group by conv_id
"""

STATEMENTS = {"op9_warc": WARC, "op10_line_dedup": LINE_DEDUP, "op11_chat": CHAT, "op12_merkle": MERKLE}
