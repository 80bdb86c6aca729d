"""DuckDB SQL for the operators that SQL can express: the contracts' words as plain joins and windows."""

from __future__ import annotations

from collections.abc import Iterable

from callscope.llm.licenses import as_pattern, mandatory, parse
from callscope.llm.url_filter import LOWER, UPPER, UrlRule

#: The contracts' word patterns.
WORD, FOLDED_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fold(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def url_filters(rules: Iterable[tuple[str, str, str]], hints: Iterable[UrlRule]) -> str:
    listed = ", ".join(f"({_text(h)}, {_text(p)}, {_text(a)})" for h, p, a in rules)
    blocked = " or ".join(f"regexp_matches(host || path, {_text(r.pattern)})" for r in hints if r.action == "block") or "false"
    return f"""
    with rules(h, p, action) as (values {listed}),
    cut as (
        select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
    ),
    parts as (
        select page_id, {_fold("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from cut
    ),
    fits as (
        select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as action
        from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        group by page_id
    )
    select page_id, host, path, rule, coalesce(action, case when {blocked} then 'block' else 'allow' end) as verdict
    from parts left join fits using (page_id)"""


def decontamination(n: int = 10) -> str:
    words = f"regexp_extract_all({_fold('text')}, '{FOLDED_WORD}')"
    return f"""
    with docs as materialized (select doc_id, coalesce({words}, []) as w from documents),
    items as (select cast(item_id as varchar) as item_id, {words} as w from benchmark),
    item_windows as materialized (
        select distinct item_id, least(len(w), {n}) as size, array_to_string(w[i : i + least(len(w), {n}) - 1], ' ') as k
        from (select item_id, w, unnest(generate_series(1, greatest(len(w) - {n - 1}, 1))) as i from items where len(w) > 0)
    ),
    sizes as (select distinct size from item_windows),
    doc_windows as (
        select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as k
        from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from docs, sizes where len(w) >= size)
    ),
    found as materialized (select doc_id, size, i, item_id from doc_windows join item_windows using (size, k)),
    hit as (
        select doc_id, count(distinct pos) as n_hit
        from (select doc_id, unnest(generate_series(i, i + size - 1)) as pos from (select distinct doc_id, size, i from found))
        group by doc_id
    ),
    named as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct doc_id, item_id from found) group by doc_id
    )
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit using (doc_id) left join named using (doc_id)"""


def substring_dedup(window: int = 20) -> str:
    return f"""
    with docs as materialized (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
    windows as (
        select doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') as k
        from (select doc_id, w, unnest(generate_series(1, len(w) - {window - 1})) as i from docs where len(w) >= {window})
    ),
    later as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as nth from windows),
    gone as materialized (
        select distinct doc_id, unnest(generate_series(i, i + {window - 1})) as pos from later where nth > 1
    ),
    words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as pos from docs),
    kept as (
        select doc_id, string_agg(word, ' ' order by pos) as text from words anti join gone using (doc_id, pos) group by doc_id
    ),
    removed as (select doc_id, count(*) as n from gone group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
    from docs left join kept using (doc_id) left join removed using (doc_id)"""


def near_duplicates(k: int, threshold_percent: int = 80) -> str:
    return f"""
    with recursive docs as (select doc_id, coalesce(regexp_extract_all({_fold("text")}, '{WORD}'), []) as w from documents),
    sets as materialized (
        select doc_id, list_sort(list_distinct(list_transform(
            generate_series(1, case when len(w) = 0 then 0 else greatest(len(w) - {k - 1}, 1) end),
            lambda i: md5(array_to_string(w[i : i + {k - 1}], ' '))))) as s
        from docs
    ),
    classes as materialized (select s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by s),
    grams as materialized (select rep, n, unnest(s) as g from classes),
    links as materialized (
        select a.rep as u, b.rep as v
        from grams a join grams b on a.g = b.g and a.rep != b.rep
            and 100 * least(a.n, b.n) >= {threshold_percent} * greatest(a.n, b.n)
        group by a.rep, b.rep, a.n, b.n
        having 100 * count(*) >= {threshold_percent} * (a.n + b.n - count(*))
    ),
    reach(u, v) as (select u, v from links union select reach.u, links.v from reach join links on reach.v = links.u),
    least_of as (select u, min(v) as v from reach group by u)
    select doc_id, cast(len(sets.s) as bigint) as n_shingles, least(coalesce(rep, doc_id), coalesce(v, rep, doc_id)) as component_id,
        doc_id = least(coalesce(rep, doc_id), coalesce(v, rep, doc_id)) as kept
    from sets left join classes using (s) left join least_of on rep = u"""


def sharding(n_shards: int = 8) -> str:
    """The checksum goes through the bytes with the table of the reflected polynomial, as a fold over their values."""
    step = "case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"
    return f"""
    with recursive bits(b, c, r) as (
        select range, range, 0 from range(256) union all select b, {step.format(c='c')}, r + 1 from bits where r < 8
    ),
    crc as materialized (select list(c order by b) as t from bits where r = 8),
    sized as materialized (
        select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size, hex(encode(coalesce(text, ''))) as bytes from documents
    ),
    summed as materialized (
        select doc_id, size, xor(4294967295, list_reduce(
            list_transform(regexp_extract_all(bytes, '..'), lambda x: cast('0x' || x as bigint)),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) as text_crc32
        from sized, crc
    ),
    placed as (
        select doc_id, size, text_crc32,
            cast((sum(size) over (order by doc_id) - size) * {n_shards} // (sum(size) over ()) as int) as shard
        from summed
    )
    select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard,
        row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as int) as grown_shard
    from placed"""


def licenses(templates: dict[str, Iterable[str]], phrases: dict[str, str]) -> str:
    """Templates as regular expressions over the folded words, each followed by a blank."""
    fits, most = [], ["0"]
    for label, template in [(label, t) for label, own in templates.items() for t in own] + list(phrases.items()):
        nodes = parse(template)
        test = f"regexp_matches(j, {_text(' ' + as_pattern(nodes))})"
        fits.append(f"case when {test} then {_text(label)} end")
        most.append(f"case when {test} then {mandatory(nodes)} else 0 end")
    places, base = [], []
    for label, phrase in phrases.items():
        words = phrase.split()
        test = " and ".join(f"w[i + {k}] = {_text(x)}" for k, x in enumerate(words))
        places.append(f"list_filter(generate_series(1, len(w) - {len(words) - 1}), lambda i: {test})")
        base.append(f"case when regexp_matches(j, {_text(' ' + ' '.join(words) + ' ')}) then {_text(label)} end")
    names = lambda listed: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(listed)}], lambda x: x is not null))), ',')"
    return f"""
    with docs as materialized (select doc_id, coalesce(regexp_extract_all({_fold('text')}, '{FOLDED_WORD}'), []) as w from documents),
    joined as materialized (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as j, list_concat({', '.join(places)}) as starts from docs)
    select doc_id, cast(len(w) as bigint) as n_words, cast(len(starts) as bigint) as n_base, list_min(starts) - 1 as first_word, list_max(starts) - 1 as last_word,
        {names(base)} as base_labels, {names(fits)} as labels, greatest({', '.join(most)}) / (greatest({', '.join(most)}) + 4) as score
    from joined"""


def ranked_search(k: int = 10) -> str:
    terms = lambda column: f"regexp_extract_all({_fold(column)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    with docs as materialized (select row_number() over () as r, doc_id, {terms('text')} as w from documents),
    stats as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from docs where len(w) > 0),
    asked as materialized (
        select i, item_id, term, count(*) as qtf
        from (select row_number() over () as i, item_id, unnest({terms('text')}) as term from benchmark) group by i, item_id, term
    ),
    held as materialized (
        select r, doc_id, n, term, count(*) as tf
        from (select r, doc_id, len(w) as n, unnest(w) as term from docs) semi join asked using (term) group by r, doc_id, n, term
    ),
    weights as (
        select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as weight from held, stats group by term, n_docs
    ),
    impacts as materialized (
        select r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) as impact
        from held join weights using (term), stats
    ),
    scores as (
        select i, item_id, r, doc_id, cast(sum(qtf * impact) as bigint) as score from asked join impacts using (term) group by i, item_id, r, doc_id
    )
    select item_id, cast(row_number() over (partition by i order by score desc, doc_id) as int) as rank, doc_id, score
    from scores where score > 0 qualify rank <= {k}"""
