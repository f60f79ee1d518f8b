"""The same questions in SQL, written independently of the Spark plans."""

from __future__ import annotations

from quillstream.functions.config import BOILERPLATE, SUBSTITUTIONS
from quillstream.operators.cues import ABBREVIATIONS
from quillstream.operators.layout import HEADING_WORDS
from quillstream.sources.segments import DECORATED_TEXT, DECORATED_TYPE

CITATIONS = (
    "Smith et al., 2020", "Smith & Jones, 2019a; Doe, 2001", "12–15", "2020", "Müller, 2020", "see Smith, 2020", "Smith, Jones, & Doe, 2020", "12a", "", " 7 ", "12, 13; 14",
    "Doe 1999", "van Dyke and Lee, 2003", "Dyke and Lee, 2003b", "Lee-Smith, 2003", "2003;", "1-2-3", "Smith et al. 2020; Lee, 1",
)
MODEL_FILES = [
    (d, f, f == "espeak-ng-data")
    for d, names in {
        "a": "m.onnx voices.bin tokens.txt", "b": "m.onnx voices.bin tokens.txt lexicon-us.txt espeak-ng-data", "c": "m.onnx tokens.txt phone.fst date.fst",
        "d": "a.onnx vocos.onnx tokens.txt", "e": "readme.md", "f": "m.onnx voices.bin tokens.txt", "g": "m.onnx tokens.txt manifest.json", "h": "z.onnx y.onnx tokens.txt", "i": "m.onnx tokens.txt",
    }.items()
    for f in names.split()
]
MANIFESTS = [("g", '{"engine": "vits", "files": {"model": "other.onnx"}}'), ("e", '{"engine": "kitten"}'), ("i", '{"files": {"model": "only.onnx"}}')]
OVERRIDES = [("f", "kitten"), ("h", "nobody"), ("g", "kokoro")]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LINES = """lines as (
  select doc_id, unnest(range(len(p))) as pos, unnest(p) as line
  from (select doc_id, string_split(text, chr(10)) as p from documents))"""
PLAIN = f"""with {LINES},
seg as (
  select doc_id, pos as seq, 'paragraph' as type, (floor(pos / 20) + 1)::int as page, line as text from lines)"""
DRESSED = f"""with {LINES},
seg as (
  select doc_id, pos as seq, {DECORATED_TYPE} as type, (floor(pos / 20) + 1)::int as page, {DECORATED_TEXT} as text from lines)"""
ALL = "select doc_id, seq, type, page, text from"


def substituted(x: str) -> str:
    for match, spoken in SUBSTITUTIONS:
        x = f"regexp_replace({x}, {q(match.replace('.', chr(92) + '.'))}, {q(spoken)}, 'gi')"
    return x


def tracked() -> str:
    steps, tags, prev = [], [], "text"
    for k, (match, spoken) in enumerate(SUBSTITUTIONS):
        pattern = q(match.replace(".", "\\."))
        tags.append(f"case when regexp_matches({prev}, {pattern}, 'i') then {q(f'{match}→{spoken}')} end")
        steps.append(f"t{k} as (select *, regexp_replace({prev}, {pattern}, {q(spoken)}, 'gi') as x{k} from {f't{k - 1}' if k else 'seg'})")
        prev = f"x{k}"
    return f"""{DRESSED}, {', '.join(steps)},
tags as (select doc_id, seq, concat_ws(', ', {', '.join(tags)}) as names from t{len(SUBSTITUTIONS) - 1})
select doc_id, seq, 'substituted: ' || names as debug_tag from tags where names <> ''"""


CAPTION = r"^(figure|fig|table|tbl)\.?\s*\d+[a-z]?(\.\d+)?\s*[:.\-–]?\s*"
INLINE = r"\(\s*(see\s+)?(figure|fig|table|tbl)\.?\s*\d+[a-z]?(\.\d+)?\s*\)"
BOILER = " or ".join(f"regexp_matches({trim('text')}, {q('(?i)' + p)})" for p in BOILERPLATE)
ISLAND = f"""{DRESSED},
run as (select *, type = 'table-row' and coalesce(lag(type) over (partition by doc_id order by seq) = 'table-row', false) as inner_row from seg)"""

SPANS = f"""{DRESSED},
chars as (
  select doc_id, seq, text, unnest(range(1, length(text) + 1)) as i from seg where contains(text, '(') and contains(text, ')')),
signs as (
  select *, case substr(text, i, 1) when '(' then 1 else -1 end as d from chars where substr(text, i, 1) in ('(', ')')),
sums as (
  select *, sum(d) over w as s from signs window w as (partition by doc_id, seq order by i)),
depths as (
  select *, s - least(0, min(s) over (partition by doc_id, seq order by i)) as depth from sums),
ends as (
  select *, coalesce(lag(depth) over (partition by doc_id, seq order by i), 0) as before from depths),
edges as (
  select doc_id, seq, text, i, before = 0 and depth = 1 as opens, before = 1 and depth = 0 as closes from ends),
paired as (
  select *, lead(i) over (partition by doc_id, seq order by i) as stop, lead(closes) over (partition by doc_id, seq order by i) as ok
  from edges where opens or closes)
"""

CUE = f"""{DRESSED},
cue as (
  select doc_id, seq as cue_index, case when text = 'RUNNING HEAD' then 'silence' else 'speech' end as kind,
    case when text <> 'RUNNING HEAD' then text end as text, case when text = 'RUNNING HEAD' then 80 end as ms, page, type,
    text <> 'RUNNING HEAD' as seg_start, case when type = 'list-item' then 'item' end as debug_tag,
    case when text = 'RUNNING HEAD' and seq % 2 = 0 then 'period' end as reason, seq % 3 <> 0 as has_ref, length(text) as size
  from seg)"""


def normal(x: str) -> str:
    return trim(rf"regexp_replace(lower({x}), '\s+', ' ', 'g')")


_SPOKEN = "|".join(a.replace(".", "\\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
_GUARD = lambda x: rf"regexp_replace({x}, '(^|[^A-Za-z.])({_SPOKEN})\.(\s)', '\1\2' || chr(57345) || '\3', 'gi')"
_S1 = rf"""regexp_replace({_GUARD(_GUARD(trim('text')))}, '([.!?])\s+([A-Z0-9"''“(])', '\1' || chr(57344) || '\2', 'g')"""
_S2 = rf"""regexp_replace({_S1}, '([,;:])\s+', '\1' || chr(57344), 'g')"""
_S3 = rf"""regexp_replace({_S2}, '(\s)([(\[{{])', '\1' || chr(57344) || '\2', 'g')"""
MARKS = (
    (".", 80, "period"), ("?", 110, "question"), ("!", 100, "exclamation"), (",", 5, "comma"), (":", 15, "colon"), (";", 20, "semicolon"),
    ("(", 5, "before-paren"), ("[", 10, "before-square"), ("{", 10, "before-curly"),
)
_MS = " ".join(f"when {q(m)} then {ms}" for m, ms, _ in MARKS)
_WHY = " ".join(f"when {q(m)} then {q(why)}" for m, _, why in MARKS)
PIECES = f"""
parts as (select doc_id, seq, string_split({_S3}, chr(57344)) as p from seg),
each as (select doc_id, seq, len(p) as n, unnest(range(1, len(p) + 1)) as i, unnest(p) as part, unnest(list_append(p[2:], '')) as follows from parts),
pieces as (
  select doc_id, seq, i, {trim("replace(part, chr(57345), '.')")} as text,
    case when i = n then '' when substr(part, length(part), 1) in ('.', '!', '?', ',', ';', ':') then substr(part, length(part), 1) else substr(follows, 1, 1) end as sign
  from each),
kept as (
  select doc_id, seq, row_number() over (partition by doc_id, seq order by i) - 1 as k, text,
    (case sign {_MS} else 0 end)::int as ms, case sign {_WHY} end as reason
  from pieces where text <> '')"""

_PACK = "list_reduce(regexp_split_to_array({0}, '\\s+'), lambda a, w: case when length(split_part(a, chr(31), -1)) + 1 + length(w) > 280 then a || chr(31) || w else a || ' ' || w end)"

ITEMS = f"""with {LINES},
numbered as (
  select doc_id, pos, (doc_id * 31 + pos) % 13 as m, string_split(line, ' ') as ws from lines),
words as (
  select doc_id, pos, m, unnest(range(len(ws))) as k, unnest(ws) as str from numbered),
items as (
  select doc_id, pos, m, k, str, 6 * length(str) as width,
    50 + case when m = 4 then 20 else 0 end
      + coalesce(sum(6 * length(str) + 3 + case when m in (8, 9, 10) then 40 else 0 end) over (partition by doc_id, pos order by k rows between unbounded preceding and 1 preceding), 0) as x,
    coalesce(lag(k) over (partition by doc_id, pos order by k) is not null, false) as follows
  from words),
raw as (
  select doc_id, pos, m, (floor(pos / 50) + 1)::int as page, {trim("regexp_replace(string_agg(str, ' ' order by k), '\\s+', ' ', 'g')")} as text,
    (700 - 12 * (pos % 50) - case when m = 12 then 6 else 0 end)::double as y, (case when m = 3 then 14 else 10 end)::double as font_size, min(x)::double as x,
    count(*) - 1 as n_gaps, (pos % 50) * 100000 + min(k) as first_item, (pos % 50) * 100000 + max(k) as last_item, length(max_by(str, k)) as last_item_len
  from items group by doc_id, pos, m),
placed as (
  select *, lag(y) over (partition by doc_id, page order by pos) - y as gap_before, row_number() over (partition by doc_id, page order by pos) - 1 as line_no from raw),
line as (select *, len(regexp_extract_all(text, '\\S+')) as n_words from placed where text <> ''),
stats as (
  select doc_id, median(font_size)::double as body_size, median(x)::double as body_margin, coalesce(median(case when gap_before > 0 then gap_before end), 0)::double as typical_gap
  from line group by doc_id),
candidate as (select *, m in (8, 9, 10) and n_gaps >= 2 and n_words between 1 and 24 as row_like from line),
island as (
  select *, row_number() over (partition by doc_id, page order by line_no) - row_number() over (partition by doc_id, page, row_like order by line_no) as island from candidate),
marked as (select *, row_like and count(*) over (partition by doc_id, page, row_like, island) >= 3 as is_table_row from island),
near as (
  select *, lag(regexp_matches(text, '[.!?][''")”’]*\\s*$')) over d as prev_ends, lag(x) over d as prev_x, lag(page) over d as prev_page,
    lead(text) over p as next_text, lead(x) over p as next_x
  from marked join stats using (doc_id)
  window d as (partition by doc_id order by page, line_no), p as (partition by doc_id, page order by line_no)),
facts as (
  select *, not regexp_matches(text, '^[a-z]') as high, not regexp_matches(text, '^[a-z]') and coalesce(prev_ends, true) as weak,
    font_size >= body_size * 1.15 as large,
    coalesce(typical_gap > 0 and gap_before > typical_gap * 1.4, false) as big_gap, coalesce(regexp_matches(next_text, '^[a-z]'), false) as goes_on,
    {trim("regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')")} as plain
  from near),
classed as (
  select *, case
    when is_table_row then 'table-row'
    when regexp_matches(text, '^\\d{{1,4}}$') then 'standalone-short'
    when high and n_words <= 20 and (regexp_matches(text, '^\\d+(\\.\\d+){{1,3}}\\.?\\s+\\S') or large and (n_words <= 14 or regexp_matches(text, '^\\d+(\\.\\d+){{0,3}}\\.?\\s+\\S'))) then 'heading'
    when weak and n_words <= 8 and not regexp_matches(text, '[a-z]') and length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 2 and regexp_matches(text, '^[A-Z0-9][A-Z0-9\\s\\-:,.''&]{{0,70}}$') then 'heading'
    when weak and n_words <= 5 and plain in ({', '.join(map(q, HEADING_WORDS))}) then 'heading'
    when weak and not goes_on and big_gap and n_words <= 10 and not regexp_matches(text, '[.!?,;:]$') then 'heading'
    when regexp_matches(text, '^[•‣◦⁃∙●▪◾\\-*]\\s+') or regexp_matches(text, '^(\\(?[0-9]{{1,3}}[).]|\\(?[a-zA-Z][).]|\\(?[ivxlcdmIVXLCDM]{{1,6}}[).])\\s+') then 'list-item'
    when x > body_margin + 8 and n_words <= 30 and (coalesce(abs(x - prev_x) <= 8, false) or not coalesce(x - next_x > 8, false)) then 'list-item'
    else 'paragraph-line' end as kind
  from facts)"""
PARAGRAPHS = f"""{ITEMS},
begun as (
  select *, (kind <> 'paragraph-line' or coalesce(lag(kind) over (partition by doc_id order by page, line_no) <> 'paragraph-line', true)
    or coalesce(prev_ends, false) and (x > body_margin + 8 or prev_page <> page))::int as starts
  from classed),
gathered as (select *, sum(starts) over (partition by doc_id order by page, line_no) - 1 as seq from begun),
framed as (
  select *, min(page) over (partition by doc_id, seq) as first_page, row_number() over (partition by doc_id, seq order by page desc, line_no desc) = 1 as ends from gathered),
whole as (
  select doc_id, seq, min(kind) as kind, min(page) as page, min_by(first_item, page * 1000 + line_no) as begin_index,
    max_by(last_item, line_no) filter (page = first_page) as end_index, max_by(last_item_len, line_no) filter (page = first_page) as end_offset,
    string_agg(case when ends then text when regexp_matches(text, '[a-z]-$') then regexp_replace(text, '-$', '') else text || ' ' end, '' order by page, line_no) as text
  from framed group by doc_id, seq)"""

_MODELS = ", ".join(f"({q(d)}, {q(f)}, {str(x).lower()})" for d, f, x in MODEL_FILES)

SQL = {
    "lines_scan": f"{PLAIN} {ALL} seg",
    "word_count": rf"{PLAIN} select doc_id, sum(len(regexp_extract_all(text, '\S+')))::bigint as n_words, count(*) as n_lines from seg group by doc_id",
    "page_limit": f"{PLAIN} {ALL} seg where page <= 2",
    "boilerplate_filter": f"{DRESSED} {ALL} seg where {trim('text')} = '' or not ({BOILER})",
    "repeated_lines": f"""{DRESSED},
t as (select *, case when length({trim('text')}) between 1 and 80 then {trim('text')} end as t from seg),
c as (select *, count(t) over (partition by doc_id, t) as n, count(distinct page) over (partition by doc_id) as pages from t)
{ALL} c where t is null or n < greatest(3, ceil(pages * 0.1))""",
    "repeated_lines_by_host": rf"""with cut as (
  select page_id, ('0x' || substr(md5(regexp_extract(url, '://([^/?#]*)', 1)), 1, 15))::bigint as doc_id, regexp_split_to_array(html, '<[^>]*>') as p from pages),
parts as (select page_id, doc_id, unnest(range(len(p))) as pos, unnest(p) as text from cut),
seg as (select doc_id, page_id * 1000000 + pos as seq, 'paragraph' as type, page_id::int as page, text from parts where regexp_matches(text, '\S')),
t as (select *, case when length({trim('text')}) between 1 and 80 then {trim('text')} end as t from seg),
c as (select *, count(t) over (partition by doc_id, t) as n, count(distinct page) over (partition by doc_id) as pages from t)
{ALL} c where t is null or n < greatest(3, ceil(pages * 0.1))""",
    "stop_at_references": rf"""{DRESSED},
c as (select *, min(case when type = 'heading' and regexp_matches({trim('text')}, '(?i)^(references|bibliography|works cited|literature cited)\b') then seq end) over (partition by doc_id) as cut from seg)
{ALL} c where cut is null or seq < cut""",
    "table_runs_replace": f"{ISLAND} select doc_id, seq, type, page, case when type = 'table-row' then 'table omitted' else text end as text from run where not inner_row",
    "table_runs_skip": f"{DRESSED} {ALL} seg where type <> 'table-row'",
    "captions_skip": f"{DRESSED} {ALL} seg where not regexp_matches({trim('text')}, {q('(?i)' + CAPTION)})",
    "captions_replace": f"{DRESSED} select doc_id, seq, type, page, case when regexp_matches({trim('text')}, {q('(?i)' + CAPTION)}) then 'figure omitted' else text end as text from seg",
    "captions_silent": f"""{DRESSED}, c as (select *, regexp_matches({trim('text')}, {q('(?i)' + CAPTION)}) as hit from seg)
select doc_id, seq, type, page, case when hit then '' else text end as text, case when hit then 250 else 0 end::bigint as pause_ms from c""",
    "captions_inline": f"""{DRESSED},
c as (select *, regexp_split_to_array(text, {q('(?i)' + INLINE)}) as p from seg)
select doc_id, seq, type, page, array_to_string(p, 'figure omitted') as text,
  case when len(p) = 1 then 1 else len(list_filter(p, lambda x: x <> '')) + len(p) - 1 end::bigint as n_tokens from c""",
    "bracket_spans": f"""{SPANS}
select doc_id, seq, row_number() over (partition by doc_id, seq order by i) - 1 as k, substr(text, i, stop - i + 1) as span from paired where opens and coalesce(ok, false)""",
    "brackets_cut": rf"""{DRESSED},
c as (select *, regexp_split_to_array(text, '\[[^\[\]]*\]') as p from seg)
select doc_id, seq, type, page, array_to_string(p, '') as text,
  case when len(p) = 1 then 1 else len(list_filter(p, lambda x: x <> '')) + len(p) - 1 end::bigint as n_tokens from c""",
    "citation_shape": rf"""with c as (select unnest([{', '.join(map(q, CITATIONS))}]) as content)
select content, regexp_matches(content, '^\s*(({{a}},?\s*\d{{4}}[a-z]?)(\s*;\s*{{a}},?\s*\d{{4}}[a-z]?)*|\d+(\s*[,;\-–]\s*\d+)*)\s*$') as is_citation from c""".replace("{{a}}", r"[A-Z][\w.\-]+(\s+(&|and)\s+[A-Z][\w.\-]+)?(\s+et al\.?)?").replace("{a}", r"[A-Z][\w.\-]+(\s+(&|and)\s+[A-Z][\w.\-]+)?(\s+et al\.?)?"),
    "heading_normalize": rf"""{DRESSED},
c as (select *, type = 'heading' and regexp_matches({trim('text')}, '^(\d+(\.\d+)*)\.?\s+(.*)$') as hit from seg)
select doc_id, seq, type, page, case when hit then 'Section ' || regexp_extract({trim('text')}, '^(\d+(?:\.\d+)*)\.?\s+(.*)$', 1) || '.' || regexp_extract({trim('text')}, '^(\d+(?:\.\d+)*)\.?\s+(.*)$', 2) else text end as text,
  case when hit then 120 else 0 end::bigint as pause_ms from c""",
    "substitutions": f"{DRESSED} select doc_id, seq, type, page, {substituted('text')} as text from seg",
    "substitutions_tracked": tracked(),
    "structural_pauses": f"""{DRESSED},
n as (select *, lead(type) over (partition by doc_id order by seq) as nxt from seg),
w as (
  select *, case when type = 'list-item' and nxt = 'list-item' then 'between-list-items' when nxt = 'list-item' then 'before-list' when type = 'heading' then 'after-heading'
    when nxt = 'heading' then 'before-heading' else 'paragraph-gap' end as reason from n)
select doc_id, seq, 0::bigint as sub, type, page, null::int as ms, null::varchar as reason from w
union all
select doc_id, seq, 1, 'pause-marker', page, case reason when 'between-list-items' then 20 when 'before-list' then 25 when 'after-heading' then 80 when 'before-heading' then 120 else 100 end, reason
from w where nxt is not null""",
    "cue_split_punct": f"{DRESSED}, {PIECES} select doc_id, seq, k, text, ms, reason from kept",
    "cue_split_legacy": rf"""{DRESSED},
a as (select doc_id, seq, string_split(regexp_replace({trim('text')}, '([.!?])\s+([A-Z0-9"''“(])', '\1' || chr(57344) || '\2', 'g'), chr(57344)) as p from seg),
b as (select doc_id, seq, flatten(list_transform(p, lambda x: case when length(x) <= 280 then [x] else string_split(regexp_replace(x, '([,;:])\s+', '\1' || chr(57344), 'g'), chr(57344)) end)) as p from a),
c as (select doc_id, seq, unnest(range(len(p))) as i, unnest(p) as part from b)
select doc_id, seq, row_number() over (partition by doc_id, seq order by i) - 1 as k, {trim('part')} as text from c where {trim('part')} <> ''""",
    "cap_length": rf"""{DRESSED},
a as (select doc_id, seq, case when length({trim('text')}) <= 280 then [{trim('text')}] else string_split({_PACK.format(trim('text'))}, chr(31)) end as p from seg)
select doc_id, seq, unnest(range(len(p))) as k, unnest(p) as text, unnest(list_transform(range(len(p)), lambda i: case when i = len(p) - 1 then 80 else 0 end))::int as ms from a""",
    "cue_queue": rf"""{PLAIN}, {PIECES},
packed as (select doc_id, seq, k, case when length(text) <= 280 then [text] else string_split({_PACK.format('text')}, chr(31)) end as p, ms, reason from kept),
spoken as (
  select doc_id, seq, k, unnest(range(len(p))) as j, unnest(p) as text, len(p) as n, ms, reason from packed),
halves as (
  select doc_id, seq, k, j, 0 as half, 'speech' as kind, text, null::int as ms, null::varchar as reason from spoken
  union all
  select doc_id, seq, k, j, 1, 'silence', null, ms, reason from spoken where j = n - 1 and ms > 0)
select h.doc_id, row_number() over (partition by h.doc_id order by h.seq, k, j, half) - 1 as cue_index, kind, h.text, ms, page, type,
  kind = 'speech' and k = 0 and j = 0 as seg_start, reason
from halves h join (select doc_id, seq, page, type from seg) using (doc_id, seq)""",
    "seek_page": f"""{CUE}, probe as (select distinct doc_id, unnest([1, 2, 3, 9]) as page from documents)
select p.doc_id, p.page, coalesce(min(case when c.page >= p.page then cue_index end), max(cue_index), -1) as cue_index
from probe p left join cue c on c.doc_id = p.doc_id group by p.doc_id, p.page""",
    "seek_text": f"""{CUE},
probe as (select distinct doc_id, '  ' || lower(line) as text, 2 as hint_page from lines),
n as (select *, substr({normal('text')}, 1, 80) as needle from probe),
s as (select *, {normal('text')} as hay from cue where kind = 'speech'),
m as (
  select n.doc_id, n.text, n.hint_page, s.cue_index, case when s.page = hint_page then 0 when s.page >= hint_page then 1 else 2 end as tier
  from n join s on n.doc_id = s.doc_id and needle <> '' and length(hay) >= 20 and (contains(hay, substr(needle, 1, 40)) or contains(needle, substr(hay, 1, 40)))),
b as (select doc_id, text, hint_page, arg_min(cue_index, tier * 1000000 + cue_index) as found from m group by all)
select n.doc_id, n.text, n.hint_page, coalesce(found, -1) as cue_index from n left join b using (doc_id, text, hint_page)""",
    "seek_heading": f"""{CUE}
select doc_id, cue_index, min(case when type = 'heading' and seg_start then cue_index end) over (partition by doc_id order by cue_index rows between 1 following and unbounded following) as next_heading,
  max(case when type = 'heading' and seg_start then cue_index end) over (partition by doc_id order by cue_index rows between unbounded preceding and 1 preceding) as previous_heading from cue""",
    "seek_skip": f"""{CUE}, t as (select *, count(*) over (partition by doc_id) as total from cue)
select doc_id, cue_index, least(total - 1, cue_index + 1) as forth, greatest(0, cue_index - 1) as back, floor(cue_index / total * 100 + 0.5)::int as percent from t""",
    "seek_status": f"""{CUE}, t as (select doc_id, count(*) as total from cue group by doc_id), d as (select doc_id, 3::bigint as position from documents)
select d.doc_id, position, page, type, kind, text, coalesce(total, 0) as total, case when total > 0 then floor(3 / total * 100 + 0.5)::int else 0 end as percent
from d left join t using (doc_id) left join cue c on c.doc_id = d.doc_id and cue_index = position""",
    "seek_page_count": f"""{CUE}
select doc_id, case when doc_id % 4 = 0 then 77 else max_by(page, cue_index) end as page_count from cue group by doc_id""",
    "debug_window": f"""{CUE},
s as (
  select doc_id, cue_index, kind, case when kind = 'silence' then '{{pause: ' || coalesce(reason, 'unlabeled') || ', ' || ms || 'ms}}' else case when debug_tag is null then '' else '[' || debug_tag || '] ' end || text end as shown from cue),
w as (
  select *, max(cue_index) over (partition by doc_id) as last, list(shown) over (partition by doc_id order by cue_index rows between 8 preceding and 1 preceding) as pre,
    list(shown) over (partition by doc_id order by cue_index rows between 1 following and 2 following) as post from s)
select doc_id, cue_index, concat_ws(' ', case when cue_index > 8 then '…' end, case when len(pre) > 0 then array_to_string(pre, ' ') end,
  case when kind = 'speech' then '▶' || shown || '◀' else shown end, case when len(post) > 0 then array_to_string(post, ' ') end, case when cue_index + 2 < last then '…' end) as debug_text from w""",
    "text_preview": f"{CUE} select doc_id, cue_index, case when length(text) > 90 then substr(text, 1, 89) || '…' else text end as preview from cue where text is not null",
    "passage_links": f"""{CUE}
select doc_id, cue_index, '[[doc-' || doc_id || '#page=' || page || case when has_ref then '&selection=' || cue_index || ',0,' || (cue_index + 1) || ',' || size else '' end || ']]' as link from cue""",
    "layout_lines": f"{ITEMS} select doc_id, page, line_no, text, font_size, x, y, gap_before, n_gaps from line",
    "layout_stats": f"{ITEMS} select doc_id, body_size, body_margin, typical_gap from stats",
    "layout_table_rows": f"{ITEMS} select doc_id, page, line_no, is_table_row from marked",
    "layout_classes": f"{ITEMS} select doc_id, page, line_no, kind from classed",
    "layout_segments": rf"""{PARAGRAPHS}
select doc_id, seq::bigint as seq, case when kind in ('heading', 'list-item', 'table-row') then kind else 'paragraph' end as type, page,
  case when kind = 'list-item' then regexp_replace(regexp_replace(text, '^[•‣◦⁃∙●▪◾\-*]\s+', ''), '^(\(?[0-9]{{1,3}}[).]|\(?[a-zA-Z][).]|\(?[ivxlcdmIVXLCDM]{{1,6}}[).])\s+', '') else text end as text,
  begin_index::int as begin_index, end_index::int as end_index, end_offset::int as end_offset from whole""",
    "saved_positions": """with e as (select user_id as file, ts, (floor(value) % 7)::int as page from events),
w as (select *, lag(page) over (partition by file order by ts, page) as was from e),
c as (select file, ts, page, lead(ts) over (partition by file order by ts, page) as nxt from w where was is null or was <> page)
select file, ts, page from c where nxt is null or epoch_ms(nxt) - epoch_ms(ts) > 3600000""",
}
_SAVED = SQL["saved_positions"].replace("select file, ts, page from c where", "s as (select file, ts, page from c where", 1) + ")"
_SAVED = _SAVED.replace("<> page)\ns as", "<> page),\ns as")
SQL["saved_positions"] = SQL["saved_positions"].replace("select file, ts, page from c", "select file, epoch_us(ts) as ts_us, page from c")
SQL["last_positions"] = f"{_SAVED} select file, arg_max(page, epoch_us(ts)::hugeint * 100 + page) as page from s group by file"
SQL["resume_hints"] = f"""{_SAVED}, l as (select file, arg_max(page, epoch_us(ts)::hugeint * 100 + page) as saved from s group by file)
select c_custkey as file, 3 as page, c_custkey % 5 = 0 as selection_mode, case when c_custkey % 5 <> 0 and saved <> 3 then saved end as hint_page
from customer left join l on file = c_custkey"""
SQL["model_resolve"] = f"""with files(model_dir, file_name, is_dir) as (values {_MODELS}),
i as (
  select model_dir, count(*) filter (ends_with(file_name, '.onnx')) as n_onnx, min(file_name) filter (ends_with(file_name, '.onnx')) as first,
    bool_or(file_name = 'voices.bin') as voices, bool_or(file_name = 'tokens.txt') as tokens, bool_or(regexp_matches(file_name, '^lexicon.*\\.txt$')) as lexicon,
    bool_or(regexp_matches(file_name, '(vocoder|vocos).*\\.onnx$')) as vocoder,
    coalesce(string_agg(model_dir || '/' || file_name, ',' order by case file_name when 'phone.fst' then 1 when 'date.fst' then 2 else 3 end) filter (file_name in ('phone.fst', 'date.fst', 'number.fst')), '') as rule_fsts
  from files group by model_dir),
g as (
  select *, case model_dir when 'f' then 'kitten' when 'h' then 'nobody' when 'g' then 'kokoro' end as override, case model_dir when 'e' then 'kitten' when 'g' then 'vits' end as told,
    case model_dir when 'g' then 'other.onnx' when 'i' then 'only.onnx' end as file from i),
e as (
  select *, n_onnx = 1 and voices and not lexicon as unclear,
    case when n_onnx >= 2 and vocoder then 'matcha' when n_onnx = 1 and voices then 'kokoro' when n_onnx = 1 and tokens then 'vits' end as guess from g),
r as (
  select *, coalesce(override, told) as given, coalesce(override, told, case when not unclear then guess end) as name from e),
s as (
  select *, case when given is null and unclear then 'ambiguous: kokoro, kitten' when name is null then 'unrecognized' when name not in ('matcha', 'kokoro', 'vits', 'kitten') then 'unknown engine' else 'ok' end as status from r)
select model_dir, case when status = 'ok' then name end as engine,
  case when status = 'ok' then case when override is not null then 'override' when told is not null then 'manifest' else 'heuristic' end end as detected_by,
  status, n_onnx, case when status = 'ok' then model_dir || '/' || coalesce(file, case when name <> 'matcha' then first end) end as model_file, rule_fsts from s"""


def tok(value: str, tag: str = "null") -> str:
    return f"{{'kind': 'text', 'value': {value}, 'ms': null::int, 'debug_tag': {tag}::varchar, 'reason': null::varchar}}"


def silent(ms: int, reason: str) -> str:
    return f"{{'kind': 'pause', 'value': null::varchar, 'ms': {ms}::int, 'debug_tag': null::varchar, 'reason': {q(reason)}}}"


def cut_at(pattern: str, marker: str, whole: str) -> str:
    """Text tokens split where a pattern matches, a marker at each such place; `whole` is what a token without a match becomes."""
    parts = f"list_filter(flatten(list_transform(range(len(p)), lambda i: case when i = 0 then [{tok('p[1]')}] else [{marker}, {tok('p[i + 1]')}] end)), lambda x: x.kind = 'pause' or x.value <> '')"
    return f"flatten(list_transform(tokens, lambda t: case when t.kind = 'text' then list_transform([regexp_split_to_array(t.value, {q(pattern)})], lambda p: case when len(p) = 1 then [{whole}] else {parts} end)[1] else [t] end))"


def flow(source: str, whole: bool = True) -> str:
    """CTEs from seg to final (doc_id, seq, sub, pos, type, page, kind, value, ms, debug_tag, reason), all rules in order; selections pass the rules that need no document."""
    steps = [source]
    if whole:
        steps += [
            f"t as (select *, case when length({trim('text')}) between 1 and 80 then {trim('text')} end as t from seg)",
            "c as (select *, count(t) over (partition by doc_id, t) as n, count(distinct page) over (partition by doc_id) as pages from t)",
            "f1 as (select doc_id, seq, type, page, text from c where t is null or n < greatest(3, ceil(pages * 0.1)))",
            "f2 as (select *, type = 'table-row' and coalesce(lag(type) over (partition by doc_id order by seq) = 'table-row', false) as inner_row from f1)",
            "f3 as (select doc_id, seq, type, page, case when type = 'table-row' then 'table omitted' else text end as text from f2 where not inner_row)",
            f"f4 as (select * from f3 where {trim('text')} = '' or not ({BOILER}))",
            f"f5 as (select doc_id, seq, type, page, [{tok('text')}] as tokens from f4 where not regexp_matches({trim('text')}, {q('(?i)' + CAPTION)}))",
            f"f6 as (select * replace ({cut_at('(?i)' + INLINE, tok(q('figure omitted')), 't')} as tokens) from f5)",
        ]
    else:
        steps.append(f"f6 as (select doc_id, seq, type, page, [{tok('text')}] as tokens from seg)")
    joined = trim("list_aggregate(list_transform(list_filter(tokens, lambda t: t.kind = 'text'), lambda t: t.value), 'string_agg', '')")
    number = r"^(\d+(?:\.\d+)*)\.?\s+(.*)$"
    steps += [
        f"f7 as (select * replace ({cut_at(chr(92) + '[[^' + chr(92) + '[' + chr(92) + ']]*' + chr(92) + ']', silent(0, 'bracket-square'), tok('t.value'))} as tokens) from f6)",
        f"f8 as (select * replace ({cut_at('{[^{}]*}'.replace('{', chr(92) + '{').replace('}', chr(92) + '}'), silent(0, 'bracket-curly'), tok('t.value'))} as tokens) from f7)",
        f"f9 as (select *, {joined} as plain from f8)",
        f"""g1 as (select doc_id, seq, type, page, case when type = 'heading' and regexp_matches(plain, {q(number)})
  then [{tok(f"'Section ' || regexp_extract(plain, {q(number)}, 1) || '.'")}, {silent(120, 'section-number')}, {tok(f"regexp_extract(plain, {q(number)}, 2)")}] else tokens end as tokens from f9)""",
        "g2 as (select doc_id, seq, type, page, unnest(range(len(tokens))) as pos, unnest(tokens) as t from g1)",
        "g3 as (select doc_id, seq, type, page, pos, t.kind as kind, t.value as value, t.ms as ms, t.reason as reason from g2)",
    ]
    tags, prev, table = [], "value", "g3"
    for k, (match, spoken) in enumerate(SUBSTITUTIONS):
        pattern = q(match.replace(".", "\\."))
        tags.append(f"case when regexp_matches({prev}, {pattern}, 'i') then {q(f'{match}→{spoken}')} end")
        steps.append(f"s{k} as (select *, regexp_replace({prev}, {pattern}, {q(spoken)}, 'gi') as x{k} from {table})")
        prev, table = f"x{k}", f"s{k}"
    steps.append(f"named as (select *, concat_ws(', ', {', '.join(tags)}) as names from {table})")
    steps.append(f"texts as (select doc_id, seq, 0 as sub, pos::int as pos, type, page, kind, {prev} as value, ms, case when names <> '' then 'substituted: ' || names end as debug_tag, reason from named)")
    if not whole:
        return ", ".join([*steps, "final as (select * from texts)"])
    steps += [
        "nexts as (select doc_id, seq, type, page, lead(type) over (partition by doc_id order by seq) as nxt from g1)",
        """whys as (
  select *, case when type = 'list-item' and nxt = 'list-item' then 'between-list-items' when nxt = 'list-item' then 'before-list' when type = 'heading' then 'after-heading'
    when nxt = 'heading' then 'before-heading' else 'paragraph-gap' end as reason from nexts where nxt is not null)""",
        """final as (
  select * from texts
  union all
  select doc_id, seq, 1, 0, 'pause-marker', page, 'pause', null, case reason when 'between-list-items' then 20 when 'before-list' then 25 when 'after-heading' then 80 when 'before-heading' then 120 else 100 end::int, null, reason from whys)""",
    ]
    return ", ".join(steps)


def cued(source: str) -> str:
    """The cues of final: its texts split and packed, its pauses as they are."""
    key = "doc_id, seq, sub, pos"
    pieces = PIECES.replace("doc_id, seq", key).replace("from seg)", "from spoken_in)")
    return rf"""{source}, spoken_in as (select {key}, value as text from final where kind = 'text'), {pieces},
packed as (select {key}, k, case when length(text) <= 280 then [text] else string_split({_PACK.format('text')}, chr(31)) end as p, ms, reason from kept),
spoken as (select {key}, k, unnest(range(len(p))) as j, unnest(p) as text, len(p) as n, ms, reason from packed),
halves as (
  select {key}, k, j, 0 as half, 'speech' as kind, text, null::int as ms, null::varchar as reason from spoken
  union all
  select {key}, k, j, 1, 'silence', null, ms, reason from spoken where j = n - 1 and ms > 0
  union all
  select {key}, 0, 0, 1, 'silence', null, ms, reason from final where kind = 'pause' and ms > 0),
numbered_cues as (
  select h.*, f.page, f.type, f.debug_tag, row_number() over (partition by h.doc_id order by h.seq, h.sub, h.pos, k, j, half) - 1 as cue_index,
    h.kind = 'speech' and sum((h.kind = 'speech')::int) over (partition by h.doc_id, h.seq, h.sub order by h.pos, k, j, half) = 1 as seg_start
  from halves h join final f using ({key}))
select doc_id, cue_index, kind, text, ms, page, type, seg_start, case when kind = 'speech' then debug_tag end as debug_tag, reason from numbered_cues"""


_CITATION = SQL["citation_shape"].split("regexp_matches(content, ")[1].split(") as is_citation")[0]
SQL["brackets_parens"] = rf"""{SPANS},
sp as (select doc_id, seq, text, i, stop, coalesce(lag(stop) over (partition by doc_id, seq order by i), 0) as prior from paired where opens and coalesce(ok, false)),
pc as (select *, substr(text, prior + 1, i - prior - 1) as head, substr(text, i, stop - i + 1) as span, substr(text, i + 1, stop - i - 1) as content from sp),
cut as (select *, regexp_matches(content, {_CITATION}) or len(regexp_extract_all(content, '\S+')) >= 4 as goes from pc),
made as (
  select doc_id, seq, string_agg(head || case when goes then 'aside' else span end, '' order by i) as front, max(stop) as last, count(*) + count(*) filter (head <> '') as n from cut group by doc_id, seq)
select doc_id, seq, type, page, case when n is null then text else front || substr(text, last + 1) end as text,
  case when n is null then 1 else n + (substr(text, last + 1) <> '')::int end::bigint as n_tokens
from seg left join made using (doc_id, seq)"""
_FLOW = flow(DRESSED)
SQL["pipeline_tokens"] = f"{_FLOW} select doc_id, seq, sub, pos, kind, value, ms, debug_tag, reason from final"
SQL["pipeline_segments"] = f"""{_FLOW}
select doc_id, seq, type, page, coalesce(string_agg(case when kind = 'text' then value end, '' order by pos), '') as text,
  coalesce(sum(ms) filter (kind = 'pause'), 0)::bigint as pause_ms, count(*) as n_tokens
from final group by doc_id, seq, sub, type, page"""
SQL["pipeline_cues"] = cued(_FLOW)
SQL["narrate_selections"] = cued(flow("with seg as (select conv_id * 1000 + turn as doc_id, 0::bigint as seq, 'paragraph' as type, 1 as page, text from conversations)", whole=False))
SQL["narrate_items"] = cued(flow(f"{PARAGRAPHS}, seg as (select doc_id, seq, type, page, text from ({SQL['layout_segments'].removeprefix(PARAGRAPHS)}))"))
SQL["project_items"] = f"""with {LINES},
w as (select doc_id, pos, unnest(range(len(p))) as k, unnest(p) as word from (select doc_id, pos, string_split(line, ' ') as p from lines)),
n as (select *, length(word) as n, case when length(word) % 4 = 0 then 0 else length(word) end as side, case when k % 2 = 0 then 3 else 0 end as lean from w)
select doc_id, pos::int as page, k::int as item_index, word as str, (k * 10)::double as x, (pos * 12)::double as y, case when k % 3 <> 0 then 6.5 * n else 6 * n end::double as width,
  case when lean <> 0 or side <> 0 then sqrt(lean * lean + side * side) else 10 end::double as font_size
from n where n % 5 <> 0"""
