"""SQL for the queries that it can express."""

from __future__ import annotations

from profilar.plans.hash_text import SEED, hash_steps


CRC_TABLE = """(select list(v order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384)
                                                                      else c >> 1 end) as v
        from range(256) r(i)))"""


def crc32(digits: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits; ``t`` is the table of ``CRC_TABLE``."""
    return f"""xor(4294967295, list_reduce(
               list_prepend(4294967295::bigint, list_transform(range(length({digits}) // 2),
                 lambda i: (instr('0123456789ABCDEF', {digits}[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', {digits}[2 * i + 2]) - 1)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def sharding(shards: int, bits: int) -> str:
    """Rendezvous choice, sizes, checksums and slots."""
    return f"""
    with docs as (select row_number() over () as rid, doc_id, text from documents),
    crc_table as {CRC_TABLE},
    bytes as (select rid, doc_id, text, hex(encode(text)) as x from docs),
    sums as (select rid, doc_id, coalesce(octet_length(encode(text)), 0) + 16 as size,
             case when text is null then 0 else {crc32('x')} end as text_crc32
             from bytes, crc_table),
    pairs as (select rid, doc_id, s from docs, range(-1, {shards + 1}) r(s)),
    {hash_steps('pairs', 'doc_id', f'{SEED}::ubigint', 'one')},
    keyed as (select rid, s, h as before from one),
    {hash_steps('keyed', 's', 'before', 'two')},
    costs as (select rid, s, h, -ln(((h >> 11)::double + 0.5) * pow(2.0, -53)) as cost from two),
    chosen as (select rid, arg_min(s, cost) filter (s between 0 and {shards - 1}) as shard,
                      arg_min(s, cost) filter (s >= 0) as grown_shard,
                      any_value(h >> {64 - bits}) filter (s = -1) as part from costs group by rid)
    select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
           (row_number() over (partition by shard order by part, doc_id, text_crc32, size) - 1)::bigint as slot,
           grown_shard::int as grown_shard
    from sums join chosen using (rid)"""


def line_dedup(size: int) -> str:
    """Texts without the lines that later occurrences of a repeated window cover. Keys must be unique."""
    return f"""
    with lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
                          generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
    windows as (select doc_id, pos, {', '.join(f'lead(line, {k}) over w as l{k}' for k in range(size))} from lines
                window w as (partition by doc_id order by pos)),
    whole as (select * from windows where l{size - 1} is not null),
    later as (select doc_id, pos from whole qualify row_number() over (
                partition by {', '.join(f'l{k}' for k in range(size))} order by doc_id, pos) > 1),
    gone as (select distinct doc_id, pos + k as pos from later, range({size}) r(k)),
    kept as (select doc_id, string_agg(line, chr(10) order by pos) as text, count(*) as n from lines
             anti join gone using (doc_id, pos) group by doc_id),
    counts as (select doc_id, count(*) as n from lines group by doc_id)
    select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
           (coalesce(c.n, 0) - coalesce(k.n, 0))::bigint as removed_lines
    from documents d left join kept k on d.doc_id = k.doc_id left join counts c on d.doc_id = c.doc_id"""


def conversation_repair() -> str:
    """Damage, faults, the edits of least cost by steps back from each conversation's end, and the digest of the repaired rows."""
    keep = ("case when f in ('b', 'd') then null when i = 'u' and {q} <> 2 then struct_pack(c := v[3].c + 5 * t, a := 'K' || v[3].a) "
            "when i = 'a' and {q} = 2 then struct_pack(c := v[4].c + 5 * t, a := 'K' || v[4].a) "
            "when i = 's' and {q} = 0 then struct_pack(c := v[2].c + 5 * t, a := 'K' || v[2].a) end")
    rerole = "case when f not in ('b', 'd') then struct_pack(c := v[{n}].c + 1 + 5 * t, a := 'R' || v[{n}].a) end"
    states = []
    for q in range(4):
        options = f"struct_pack(c := v[{q + 1}].c + 2, a := 'D' || v[{q + 1}].a), {keep.format(q=q)}, {rerole.format(n=4 if q == 2 else 3)}"
        states.append(f"list_min(list_filter([{options}], lambda o: o is not null))")
    end = "[struct_pack(c := 0::bigint, a := ''), struct_pack(c := 9999999999, a := '!'), struct_pack(c := 9999999999, a := '!'), struct_pack(c := 0, a := '')]"

    def inserted(v: str) -> str:
        ins = f"struct_pack(c := {v}[{{0}}].c + 5, a := 'I' || {v}[{{0}}].a)"
        u = f"list_min([{v}[3], {ins.format(4)}])"
        then = f"struct_pack(c := ({u}).c + 5, a := 'I' || ({u}).a)"
        return f"[list_min([{v}[1], {then}]), list_min([{v}[2], {then}]), {u}, list_min([{v}[4], {ins.format(3)}])]"

    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    with recursive crc_table as {CRC_TABLE},
    places as (select row_number() over () as rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as x from conversations),
    kinds as (select *, {crc32('x')} % 20 as kind from places, crc_table),
    damaged as (select conv_id, turn, case kind when 4 then 'user' else role end as role,
                case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
                from kinds, range(2) r(copy) where kind <> 0 and (copy = 0 or kind = 3)),
    placed as (select *, row_number() over w as k, rtrim(text, {white}) as cut from damaged
               window w as (partition by conv_id order by turn nulls first, role, text)),
    faults as (select *, case when cut = '' then 'b' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'd'
                         when right(cut, 1) not in ('.', '!', '?') then 't' else 'n' end as f, role[1] as i,
               lead(role[1]) over (partition by conv_id order by k) as after from placed),
    counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
               count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate, count(*) filter (f = 't') as truncated,
               count(*) filter (after is not null and i || after not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
    rest(conv_id, k, v) as (
      select conv_id, n, {inserted(end)} from counts
      union all
      select conv_id, k, {inserted('w')} from (
        select r.conv_id, r.k - 1 as k, [{', '.join(states)}] as w
        from rest r join (select conv_id, k, i, f, (f = 't')::int as t from faults) f
        on r.conv_id is not distinct from f.conv_id and r.k = f.k)),
    best as (select conv_id, v[1].c as cost, v[1].a as audit from rest where k = 0),
    edits as (select conv_id, j, audit[j] as e, count(*) filter (audit[j] <> 'I') over w as k, count(*) filter (audit[j] <> 'D') over w as o
              from best, lateral (select unnest(range(1, length(audit) + 1)) as j)
              window w as (partition by conv_id order by j rows unbounded preceding)),
    met as (select e.conv_id, e.j, e.e, e.o, f.role, f.text from edits e left join faults f
            on e.conv_id is not distinct from f.conv_id and e.k = f.k and e.e <> 'I' where e.e <> 'D'),
    led as (select *, max(case when o = 1 and e = 'K' and role[1] = 's' then 1 else 0 end) over (partition by conv_id) as s from met),
    rows_ as (select conv_id, j, case e when 'K' then role else case (o - s) % 2 when 1 then 'user' else 'assistant' end end
                             || ':' || case e when 'I' then '' else text end as line from led),
    texts as (select conv_id, string_agg(line, chr(10) order by j) as whole from rows_ group by conv_id)
    select a.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
           coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal,
           coalesce(b.cost, 0)::bigint as cost, coalesce(b.audit, '') as audit, sha256(coalesce(t.whole, '')) as repaired_sha256
    from (select distinct conv_id from conversations) a
    left join counts c on a.conv_id is not distinct from c.conv_id
    left join best b on a.conv_id is not distinct from b.conv_id
    left join texts t on a.conv_id is not distinct from t.conv_id"""
