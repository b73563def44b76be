"""The queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, htmltext, langid, linededup, packing, quality, secrets, sharding, simhash, urlfilter
from gridloom.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The shards of the cluster that the corpus is dealt to.
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
#: URL rules, longest first wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents", "doc_id"), "doc_id", SHARDS)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.col("base_spans")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.pack(docs, tokenizer_path(), keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(read(spark, sf_dir, "pages", "page_id", "url"), urlfilter.rules_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*base, "nearest", *[F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), slop=decontam.SLOP)
    digest = found.select("doc_id", "n_words", decontam.covered(F.col("hits")).alias("n_hit"), "items", F.size("near").cast("long").alias("n_near"))
    return digest.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_main_text": op6_main_text,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
}

_PATTERNS = {"vowel": "[aeiou]", "consonant": "[bcdfghjklmnpqrstvwxyz]", "capital": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": """[.,;:!?''"()-]""", "symbol": "[#*$%&|<>]", "beyond": r"[^\x00-\x7F]"}
_CLASS = {name: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))" for name, pattern in _PATTERNS.items()}
_CLASS["other"] = f"(length(t) - {' - '.join(_CLASS.values())})"
_KEYS = ", ".join(f"'{w}'" for w in quality._WORDS)
_LANGUAGES = ", ".join(f"'{lang}'" for lang in sorted(quality.COMMON_WORDS))


def _matches(name: str, pattern: str, least: int = 0, group: int = 0) -> str:
    """SQL: (id, a, z, value) of the leftmost matches of a pattern in docs, those with a group of fewer characters left out."""
    p = pattern.replace("'", "''")
    return f"""{name}_found as (select id, regexp_extract_all(t, '{p}') as found, regexp_extract_all(t, '{p}', {group}) as own, regexp_split_to_array(t, '{p}') as gaps from docs),
        {name}_each as (
            select id, own[i] as value, length(found[i]) as n,
                   list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as a
            from (select *, unnest(range(1, len(found) + 1)) as i from {name}_found)),
        {name} as (select id, cast(a as bigint) as a, cast(a + n as bigint) as z, value from {name}_each where length(value) >= {least})"""


def _entropy(name: str, kind: secrets.CharClass, must: list[str], old: str) -> str:
    """SQL: (id, a, z) of what the spans ``old`` leave of the entropy spans of a class."""
    w = secrets.WINDOW
    allow = " or ".join(f"regexp_matches(value, '{p}')" for p in secrets.ALLOW)
    return f"""{_matches(name + "_runs", f"{kind.run}{{{w},}}")},
        {name}_windows as (
            select id, a, e, list_transform(range(e - {w - 1}, e + 1), lambda i: value[i]) as chars
            from (select *, unnest(range({w}, length(value) + 1)) as e from {name}_runs where {" and ".join(f"regexp_matches(value, '{m}')" for m in must)} and not ({allow}))),
        {name}_high as (
            select id, a, e from {name}_windows where log2({w}) - list_sum(list_transform(list_distinct(chars),
                lambda c: len(list_filter(chars, lambda x: x = c)) * log2(len(list_filter(chars, lambda x: x = c))))) / {w} >= {kind.bits}),
        {name}_whole as (select id, a + min(e) - {w} as a, a + max(e) as z from {name}_high group by id, {name}_high.a),
        {name}_met as (
            select n.id, n.a, n.z, o.a as s, o.z as e, max(o.z) over (partition by n.id, n.a order by o.a, o.z rows between unbounded preceding and 1 preceding) as before
            from {name}_whole n left join {old} o on n.id = o.id and o.a < n.z and n.a < o.z),
        {name} as (
            select id, x as a, y as z from (
                select id, greatest(coalesce(before, a), a) as x, s as y from {name}_met where s is not null
                union all select id, greatest(coalesce(max(e), a), a), z from {name}_met group by id, a, z)
            where y - x >= {secrets.REST})"""


#: The shard of each slot as two hexadecimal digits.
_TABLE = "".join(f"{i:02x}" for i in sharding.lookup_table(SHARDS).tolist())

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
        with slots as (
            select doc_id, cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '')), 15) as bigint) % {len(_TABLE) // 2} as slot
            from documents)
        select doc_id, slot, cast(cast('0x' || substr('{_TABLE}', cast(2 * slot + 1 as int), 2) as bigint) as int) as shard
        from slots""",
    "op4_url_filter": r"""
        with rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        parts as (
            select page_id,
                   translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
            from pages),
        best as (
            select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
                   arg_max(verdict, length(rhost || rpath)) as verdict
            from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
            group by page_id)
        select p.page_id, host, path, b.rule, coalesce(b.verdict, 'allow') as verdict
        from parts p left join best b on p.page_id = b.page_id""",
    "op9_decontamination": r"""
        with docs as (
            select row_number() over () as doc, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from documents),
        items as (
            select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from benchmark),
        runs as (
            select item, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda s: w[s + 1 : s + 10])) as run
            from items where len(w) > 0),
        phrases as (
            select array_to_string(run, ' ') as phrase, any_value(len(run)) as size, any_value(run) as run,
                   list(distinct item) as items
            from runs group by phrase),
        -- exact matches
        sizes as (select distinct size from phrases),
        windows as (
            select doc, size, s - 1 as start, array_to_string(w[s : s + size - 1], ' ') as phrase
            from (select doc, size, w, unnest(range(1, len(w) - size + 2)) as s from docs, sizes where len(w) >= size)),
        hits as (select doc, start, v.size, v.phrase, items from windows v join phrases p on v.phrase = p.phrase),
        hit_words as (select doc, count(distinct pos) as n from (select doc, unnest(range(start, start + size)) as pos from hits) group by doc),
        hit_items as (select doc, list_sort(list(distinct item)) as items from (select doc, unnest(items) as item from hits) group by doc),
        -- near matches: places where one of the rarest terms puts a phrase
        words as (select doc, unnest(range(len(w))) as pos, unnest(w) as term from docs),
        counts as (select term, count(*) as n from words group by term),
        terms as (select phrase, size, unnest(range(size)) as off, unnest(run) as term, len(list_distinct(run)) as kinds, run from phrases),
        least as (select *, cast(ceil(kinds * 0.8 - 1e-9) as int) as enough from terms),
        ranked as (
            select l.*, dense_rank() over (partition by phrase order by coalesce(n, 0), l.term) as rank, coalesce(n, 0) as n
            from least l left join counts c on l.term = c.term),
        anchors as (select * from ranked where rank <= kinds - enough + 1 and n > 0),
        placed as (
            select distinct w.doc, phrase, w.pos - off as start, size, run, enough
            from words w join anchors a on w.term = a.term),
        near as (
            select p.doc, count(*) as n
            from placed p join docs d on p.doc = d.doc left join hits h on h.doc = p.doc and h.phrase = p.phrase and h.start = p.start
            where h.doc is null and len(list_intersect(
                d.w[greatest(p.start - 2, 0) + 1 : greatest(p.start - 2, 0) + p.size + 4], p.run)) >= enough
            group by p.doc)
        select d.doc_id, len(d.w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(len(i.items), 0) as n_items,
               sha256(coalesce(array_to_string(i.items, ','), '')) as items_sha256,
               coalesce(h.n, 0) > 0 as contaminated, coalesce(n.n, 0) as n_near
        from docs d left join hit_words h on d.doc = h.doc left join hit_items i on d.doc = i.doc left join near n on d.doc = n.doc""",
    "op2_secrets": f"""
        with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents),
        {_matches("assign", secrets.ASSIGN, 6, 2)},
        {_matches("access", "AKIA[A-Z0-9]+", 20)},
        {_matches("hex", "[0-9a-f]+", 24)},
        base as (
            select id, a, z, 0 as kind, 'assign' as name from assign union all select id, a, z, 1, 'access' from access
            union all select id, a, z, 2, 'hex' from hex),
        {_entropy("first", secrets.CLASSES[0], ["[0-9]", "[A-Fa-f]"], "base")},
        old as (select id, a, z from base union all select id, a, z from first),
        {_entropy("second", secrets.CLASSES[1], ["[0-9].*[0-9]", "[a-z]", "[A-Z]"], "old")},
        every as (
            select * from base union all select id, a, z, 3, 'entropy' from first union all select id, a, z, 3, 'entropy' from second),
        written as (
            select id, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2,
                   string_agg(name || ':' || a || ':' || z, ',' order by a, kind, z) filter (kind < 3) as base,
                   string_agg(name || ':' || a || ':' || z, ',' order by a, kind, z) as spans
            from every group by id)
        select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from docs d left join written w on d.id = w.id""",
    "op5_quality": rf"""
        with docs as (
            select row_number() over () as id, doc_id, lang, coalesce(text, '') as t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
            from documents),
        lines as (
            select id, line from (select id, unnest(string_split(t, chr(10))) as line from docs)
            where regexp_matches(line, '[^\x20\x09-\x0D]')),
        dups as (select id, count(*) - count(distinct line) as n from lines group by id),
        windows as (
            select id, i, [w[i], w[i + 1], w[i + 2]] as run
            from (select id, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) > 2)),
        often as (select id, run from windows group by id, run having count(*) > 1),
        repeats as (
            select id, count(distinct pos) as n
            from (select v.id, unnest([i, i + 1, i + 2]) as pos from windows v join often o on v.id = o.id and v.run = o.run)
            group by id),
        tokens as (
            select id, regexp_extract_all(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?''"()]', '', 'g'), '[^\x20\x09-\x0D]+') as own
            from docs),
        counts as (select id, list_transform([{_KEYS}], lambda k: len(list_filter(own, lambda x: x = k))) as common from tokens),
        measured as (
            select d.id, doc_id, lang, len(w) as n_words, [{", ".join(_CLASS[c] for c in quality.CLASSES)}] as chars,
                   list_append(common, len(w) - list_sum(common)) as common,
                   length(t) - {_CLASS["space"]} as word_chars, {_CLASS["symbol"]} as n_symbols,
                   coalesce(u.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
            from docs d join counts c on d.id = c.id left join dups u on d.id = u.id left join repeats r on d.id = r.id),
        bins as (
            select id, lang, n_words, 'c' as what, unnest(range(len(chars))) as bin, unnest(chars) as n, list_sum(chars) as total from measured
            union all
            select id, lang, n_words, 'w', unnest(range(len(common))), unnest(common), list_sum(common) from measured),
        shares as (
            select lang, what, bin, sum(cast(n * 1000000 // greatest(total, 1) as bigint)) as n
            from bins where lang in ({_LANGUAGES}) and n_words >= 50 group by lang, what, bin),
        known as (select lang, what, bin, n / sum(n) over (partition by lang, what) as b from shares),
        pairs as (
            select id, k.lang, x.what, total, case when total > 0 then x.n / total else 0 end as a, b
            from bins x join known k on x.what = k.what and x.bin = k.bin),
        distances as (
            select id, lang, what, case when any_value(total) > 0 then sqrt(greatest(sum(
                case when a > 0 then a * log2(a / ((a + b) / 2)) else 0 end + case when b > 0 then b * log2(b / ((a + b) / 2)) else 0 end) / 2, 0)) else 1.0 end as d
            from pairs group by id, lang, what),
        both_ as (
            select c.id, c.lang, c.d as by_char, w.d as by_word, row_number() over (partition by c.id order by c.d + w.d, c.lang) as place
            from distances c join distances w on c.id = w.id and c.lang = w.lang where c.what = 'c' and w.what = 'w'),
        judged as (
            select m.*, b.lang as nearest, coalesce(by_char, 1.0) as c, coalesce(by_word, 1.0) as w,
                   n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
            from measured m left join both_ b on m.id = b.id and place = 1)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and (nearest is null or not (c > case when n_words < 100 then 0.28 else 0.24 end
                   or w > case when n_words < 150 then 0.35 else 0.3 end)) as kept,
               nearest, round(c, 6) as char_distance, round(w, 6) as word_distance
        from judged""",
    "op8_line_dedup": """
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (
            select doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        frequent as (
            select key, max(doc_id) as keeper from keyed where length(key) >= 40
            group by key having count(distinct doc_id) >= 5),
        judged as (
            select k.doc_id, pos, line, (f.key is not null and k.doc_id <> keeper) as gone
            from keyed k left join frequent f on k.key = f.key)
        select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from judged group by doc_id""",
}
