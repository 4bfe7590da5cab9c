"""The catalog's queries as SQL for DuckDB, written row by row where the engine uses arithmetic."""

from __future__ import annotations

_COMMENTS = """
comments as (
  select cast(floor(event_id / 10) as bigint) as post_id, event_id, ts, user_id,
         case when event_type in ('purchase', 'signup') then 1
              when event_type = 'error' then -1 else 0 end as score
  from events)"""

_TALLY = """
tally as (
  select post_id, min(ts) as first_ts,
         count(*) filter (score = 1) as n_push,
         count(*) filter (score = -1) as n_hate,
         count(*) filter (score = 0) as n_neutral
  from comments group by post_id)"""


def _posts(posted_at: str) -> str:
    return f"""
posts as (
  select d.doc_id as post_id,
         concat(case d.doc_id % 10 when 7 then 'Re: [新聞] ' when 8 then 'Fw: [新聞] '
                                   when 9 then '[問卦] ' else '[新聞] ' end, d.source) as title,
         d.source as author, {posted_at} as posted_at,
         concat('https://board.example/post/', d.doc_id) as url,
         d.text as content, coalesce(n_push, 0) as n_push, coalesce(n_hate, 0) as n_hate,
         coalesce(n_neutral, 0) as n_neutral
  from documents d left join tally on d.doc_id = tally.post_id)"""


_EXACT = _posts("first_ts")
_HOURLY = _posts("date_trunc('hour', first_ts)")

_IS_NEWS = """contains(title, '新聞') and not contains(title, 'Re: [新聞]')
      and not contains(title, 'Fw: [新聞]')"""
_NEWS = (
    _HOURLY.replace("posts as (", "crawled as (", 1)
    + f""",
posts as (
  select * from crawled
  where post_id in (select max(post_id) from crawled where {_IS_NEWS} group by content))"""
)

_CALENDAR = """
tagged as (
  select *, hour(posted_at) as hour, dayname(posted_at) as weekday,
         case when hour(posted_at) between 4 and 8 then 'WakeUp'
              when hour(posted_at) between 9 and 17 then 'Work'
              when posted_at is not null then 'OutOfWork' end as hour_tag
  from posts)"""

_TOKENS = r"""
tokenised as (
  select post_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}') as words from posts)"""

_COUNTS = """
counts as (
  select post_id, term, count(*) as tf
  from (select post_id, unnest(words) as term from tokenised) group by all)"""

_WEIGHTS = """
stats as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from counts group by term),
raw as (
  select post_id, term, tf, df,
         tf * (ln((1 + (select count(*) from posts)) / (1 + df)) + 1) as w
  from counts join stats using (term)),
weights as (
  select post_id, term, tf, df, w / sqrt(sum(w * w) over (partition by post_id)) as weight
  from raw)"""

_KEPT = "kept as (select post_id, term, weight from weights where weight > 0.1)"

_WINDOWS = """
grid as (
  select date_trunc('day', max(posted_at)) + interval 1 day as base,
         4 * (1 + datediff('day', date_trunc('day', min(posted_at)),
                           date_trunc('day', max(posted_at)) + interval 1 day)) - 56 as k
  from posts),
windows as (
  select i as window_id,
         base - to_hours(cast(6 * (i + 56) as bigint)) as low,
         base - to_hours(cast(6 * i as bigint)) as up
  from (select base, unnest(range(k)) as i from grid))"""

_MEMBERS = """
members as (
  select window_id, post_id from posts join windows on posted_at between low and up)"""

_SCORED_BY = """
scored_by as (
  select post_id, max(window_id) as window_id
  from posts join windows on posted_at between up and up + interval 6 hour
  where window_id in (select window_id from members)
  group by post_id)"""

_TOPICS = """
topics as (
  select post_id, cast('0x' || substr(md5(term), 1, 4) as integer) % 20 as topic,
         count(*) / any_value(total) as p
  from kept join (select post_id, count(*) as total from kept group by post_id) using (post_id)
  group by all)"""

_INDEX = """
topic_sums as (
  select window_id, topic, sum(p) as counts, sum(n_push * p) as all_n_push,
         sum(n_hate * p) as all_n_hate, sum(n_neutral * p) as all_n_neutral
  from members join topics using (post_id) join posts using (post_id)
  group by window_id, topic)"""

_SCORES = """
sums as (
  select post_id, sum(all_n_push / counts * p) as score_positive,
         sum(all_n_hate / counts * p) as score_hate,
         sum(all_n_neutral / counts * p) as score_neutral
  from scored_by join topics using (post_id) join topic_sums using (window_id, topic)
  group by post_id),
scores as (
  select post_id, posted_at, coalesce(score_positive, 0) as score_positive,
         coalesce(score_hate, 0) as score_hate, coalesce(score_neutral, 0) as score_neutral,
         score_hate is not null as scored
  from posts left join sums using (post_id))"""


# The texts hold no Han characters, so segmenting them is splitting words from other signs.
_SEGMENTED = r"array_to_string(regexp_extract_all(content, '[\p{L}\p{N}_]+|\S'), ' ')"


def _cleaned(expression: str) -> str:
    out = expression
    # The literal replacements of the cleaning step, in the order they apply.
    for old, new in [
        ("''s", " ''s"),
        ("''ve", " ''ve"),
        ("n''t", " n''t"),
        ("''re", " ''re"),
        ("''d", " ''d"),
        ("''ll", " ''ll"),
        ("!", " ! "),
        ("(", " ( "),
        (")", " ) "),
        ("?", " ? "),
        ("$", " $ "),
        ("%", " % "),
    ]:
        out = f"replace({out}, '{old}', '{new}')"
    out = rf"regexp_replace({out}, '\s{{2,}}', ' ', 'g')"
    out = rf"regexp_replace({out}, '\S*(?:xx|XX)\S*', 'xxx', 'g')"
    return rf"lower(regexp_replace({out}, '^\s+|\s+$', '', 'g'))"


_CLEANED = f"cleaned as (select post_id, {_cleaned(_SEGMENTED)} as text from posts)"

_VOCABULARY = r"""
places as (
  select post_id, term, pos
  from (select post_id, regexp_extract_all(text, '[''\p{L}\p{N}_-]+') as words from cleaned),
       lateral (select unnest(words) as term, generate_subscripts(words, 1) as pos)),
vocabulary as (
  select term, row_number() over (order by seen) as term_id
  from (select term, min({'doc': post_id, 'pos': pos}) as seen from places group by term))"""

_ENCODED = """
encoded as (
  select post_id, coalesce(ids, []) as ids
  from cleaned left join (
    select post_id, list(term_id order by pos) as ids
    from places join vocabulary using (term) group by post_id) using (post_id))"""

_RANKED = """
ranked as (
  select post_id, n_hate, row_number() over (order by md5('57:' || post_id), post_id) as rank
  from posts),
sizes as (
  select ceil(count(*) * 0.2) as n_test,
         ceil((count(*) - ceil(count(*) * 0.2)) * 0.25) as n_valid from posts),
parted as (
  select post_id, n_hate, rank,
         case when rank <= n_test then 'test' when rank <= n_test + n_valid then 'valid'
              else 'train' end as split
  from ranked, sizes)"""


def _stirred(digit: str, key: str) -> str:
    spread = f"(({digit} * 48271 + {key}) % 2147483647)"
    return f"(({spread} * {spread} % 2147483647) * 16807 + {key}) % 2147483647"


_PASS = ", ".join(
    f"(l{i} + {_stirred(f'r{i}', f'k[{2 * i + 1}]')}) % a as l{i + 1}, (r{i} + {_stirred(f'l{i + 1}', f'k[{2 * i + 2}]')}) % b as r{i + 1}"
    for i in range(3)
)
#: Places of training rows in each epoch: rounds over two digits, again until the number is in range.
_PERMUTED = f"""
numbered as (
  select post_id, cast(rank - min(rank) over () as bigint) as number, count(*) over () as n
  from parted where split = 'train'),
walks as (
  select post_id, epoch, number as x, 0 as step, n, cast(floor(sqrt(n - 1)) as bigint) + 1 as a,
         (n + a - 1) // a as b,
         [cast('0x' || substr(md5('57:' || epoch || ':' || i), 1, 7) as bigint) for i in range(6)] as k
  from numbered, (select unnest(range(4)) as epoch)
  union all
  select post_id, epoch, l3 * b + r3, step + 1, n, a, b, k
  from (select *, x // b as l0, x % b as r0, {_PASS} from walks where step = 0 or x >= n))"""


def _sql(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(cte.strip() for cte in ctes) + "\n" + select.strip()


_BASE = (_COMMENTS, _TALLY, _EXACT)
_BASE_HOURLY = (_COMMENTS, _TALLY, _HOURLY)
_KEYWORDS = (_TOKENS, _COUNTS, _WEIGHTS, _KEPT)
_TREND = (*_BASE_HOURLY, *_KEYWORDS, _WINDOWS, _MEMBERS, _SCORED_BY, _TOPICS, _INDEX, _SCORES)

_TIME = "strftime(posted_at, '%Y-%m-%d %H:%M:%S') as posted_at"
_DECODE = (
    "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'),"
    " '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'),"
    " '&middot;', '·'), '&amp;', '&')"
)
_HOST = "lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#:]*)', 1))"
_ABSOLUTE = "regexp_extract(page_url, '^[A-Za-z]+://[^/?#]*') || href"

_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _matrix(value: str) -> str:
    cells = ", ".join(f"round(max({value}) filter (weekday = '{d}'), 6) as \"{d}\"" for d in _DAYS)
    return f"select hour, {cells} from cells group by hour"


_CELLS = """
cells as (
  select weekday, hour, mean,
         (mean - avg(mean) over (partition by weekday))
           / nullif(stddev_samp(mean) over (partition by weekday), 0) as z
  from (select weekday, hour, avg(n_hate) as mean from tagged group by weekday, hour))"""

_SIMPSON = """
list_sum(list_transform(range(0, 2001), lambda i:
  (case when i = 0 or i = 2000 then 1.0 when i % 2 = 1 then 4.0 else 2.0 end)
  * pow(greatest(cos({low} + i * (({high}) - ({low})) / 2000.0), 0.0), df - 1)))
  * (({high}) - ({low})) / 2000.0 / 3.0"""

_HAN = r"""
shown as (select post_id, translate(content, 'aeiounrstl', '台北市政府今天宣布例') as content from posts),
pieces as (
  select post_id, regexp_extract_all(
    regexp_replace(content, '(\p{Han}+)', ' \1 ', 'g'), '[\p{L}\p{N}_]+|\S') as raw from shown),
tokenised as (
  select post_id, regexp_extract_all(lower(array_to_string(flatten(list_transform(raw, lambda x:
    case when regexp_full_match(x, '\p{Han}{2,}')
         then list_transform(range(1, length(x)), lambda i: substring(x, i, 2))
         else [x] end)), ' ')), '[\p{L}\p{N}_]{2,}') as words
  from pieces)"""

# Strings of Han characters, and words by cohesion and branching entropy.
_GRAMS = r"""
han as (
  select post_id, translate(lower(content), 'bcdfghjklmnpqrstvwxyzaeiou ', '台北市政府今天宣布例人口大小中國山水火木金') as content
  from posts),
han_runs as (
  select post_id, unnest(regexp_extract_all(content, '\p{Han}+')) as run from han),
grams as (
  select gram, cast(n as bigint) as n, count(*) as count
  from (select n, unnest(list_transform(range(1, length(run) - n + 2), lambda i: substring(run, i, n))) as gram
        from han_runs, (select unnest([1, 2, 3, 4, 5]) as n))
  group by gram, n)"""

_WORDS_LEARNT = """
longer_left as (
  select substring(gram, 2) as gram, sum(count) as total, sum(count * ln(count)) as logs from grams where n > 2 group by 1),
longer_right as (
  select left(gram, n - 1) as gram, sum(count) as total, sum(count * ln(count)) as logs from grams where n > 2 group by 1),
free as (
  select g.gram, g.n, g.count,
         ln(g.count) - (coalesce(l.logs, 0) + case when g.count > coalesce(l.total, 0)
           then (g.count - coalesce(l.total, 0)) * ln(g.count - coalesce(l.total, 0)) else 0 end) / g.count as left_entropy,
         ln(g.count) - (coalesce(r.logs, 0) + case when g.count > coalesce(r.total, 0)
           then (g.count - coalesce(r.total, 0)) * ln(g.count - coalesce(r.total, 0)) else 0 end) / g.count as right_entropy
  from grams g left join longer_left l using (gram) left join longer_right r using (gram)
  where g.n between 2 and 4 and g.count >= 5),
learnt as (
  select f.gram, f.n, f.count,
         min(ln(f.count) + ln((select sum(count) from grams where n = 1)) - ln(h.count) - ln(t.count)) as cohesion,
         f.left_entropy, f.right_entropy
  from free f, (select unnest([1, 2, 3]) as cut), grams h, grams t
  where cut < f.n and h.gram = left(f.gram, cut) and t.gram = substring(f.gram, cut + 1) and least(left_entropy, right_entropy) >= 0.8
  group by all having cohesion >= 1.0)"""

_CUT = """
known as (select gram, count from grams where n = 1 union all select gram, count from learnt),
weights as (select gram, cast(round(ln(count / (select sum(count) from known)) * 1000000) as bigint) as w from known),
distinct_runs as (select distinct run from han_runs),
walk as (
  select run, 0 as place, [0::bigint] as best, []::int[] as lens from distinct_runs
  union all
  select run, place + 1, list_append(best, top.w), list_append(lens, top.n)
  from (
    select k.run, k.place, k.best, k.lens,
           list_max(list_filter([
             {'w': best[place + 1] + a.w, 'n': 1}, {'w': best[place] + b.w, 'n': 2},
             {'w': best[place - 1] + c.w, 'n': 3}, {'w': best[place - 2] + d.w, 'n': 4}], lambda x: x.w is not null)) as top
    from walk k left join weights a on a.gram = substring(run, place + 1, 1)
    left join weights b on place >= 1 and b.gram = substring(run, greatest(place, 1), 2)
    left join weights c on place >= 2 and c.gram = substring(run, greatest(place - 1, 1), 3)
    left join weights d on place >= 3 and d.gram = substring(run, greatest(place - 2, 1), 4)
    where place < length(run))),
back as (
  select run, lens, place as spot, []::varchar[] as words from walk where place = length(run)
  union all
  select run, lens, spot - lens[spot], list_prepend(substring(run, spot - lens[spot] + 1, lens[spot]), words) from back where spot > 0),
cut as (select run, words from back where spot = 0)"""

_SUMMARY = " union all ".join(
    f"""select '{c}' as measure, min({c}) as minimum,
      round(quantile_cont({c}, 0.25), 6) as q1, round(quantile_cont({c}, 0.5), 6) as median,
      round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.75), 6) as q3, max({c}) as maximum
    from posts"""
    for c in ("n_push", "n_hate", "n_neutral")
)

ORACLES: dict[str, str] = {
    "posts_from_json": _sql(
        *_BASE,
        """sums as (
          select post_id, sum(score) as score, count(*) as n,
                 string_agg(user_id, ',' order by event_id) as users,
                 string_agg(event_id, ',' order by event_id) as comment_texts
          from comments group by post_id)""",
        select="""
        select url, title, author, strftime(posted_at, '%Y-%m-%d %H:%M:%S') as date,
               md5(content) as content_md5, cast(coalesce(score, 0) as bigint) as score,
               coalesce(n, 0) as n_comments, coalesce(users, '') as users,
               coalesce(comment_texts, '') as comment_texts,
               cast(coalesce(score, 0) as bigint) as comment_score
        from posts left join sums using (post_id)""",
    ),
    "json_rejects": """
        select count(*) as accepted,
               count(distinct doc_id // 100) filter ((doc_id // 100) % 7 = 0) as rejected_files
        from documents""",
    "dedup_recrawled": _sql(
        *_BASE,
        select="select post_id, url, md5(content) as content_md5, n_push, n_hate, n_neutral from posts",
    ),
    "csv_roundtrip": _sql(
        *_BASE,
        select=f"select post_id, title, {_TIME}, md5(content) as content_md5, n_hate from posts",
    ),
    "index_frontier": _sql(
        f"""sites as (select 'https://' || {_HOST.format('url')} || '/board/' as base_url,
                      count(*) as n from pages group by 1)""",
        select="""
        select base_url, null::bigint as page_no, base_url || 'index.html' as url from sites
        union all
        select base_url, page_no, base_url || 'index' || page_no || '.html'
        from (select base_url, unnest(range(2, n)) as page_no from sites)""",
    ),
    "page_posts": f"""
        select page_id, url, {_HOST.format('url')} as host,
               {_DECODE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title,
               regexp_extract_all(html, '<p>([^<]*)', 1)[1] as first_paragraph,
               regexp_extract_all(html, '<p>([^<]*)', 1)[-1] as last_paragraph
        from pages
        where not regexp_matches(html, '<[^>]*\\bclass="(?:[^"]*\\s)?over18-notice[\\s"]')
          and regexp_matches(html, '<title>[^<]*</title>')""",
    "page_text": f"""
        select page_id, length(body) as n_chars, md5(body) as content_md5
        from (select page_id, {_DECODE.format(
            "regexp_replace(split_part(split_part(html, '<article>', 2), '<footer>', 1),"
            " '<[^>]*>', '', 'g')")} as body
          from pages
          where contains(html, '<article>') and contains(html, '<footer>&copy;'))""",
    "page_links": _sql(
        """links as (
          select page_id, url as page_url, unnest(h) as href, generate_subscripts(h, 1) - 1 as position
          from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages))""",
        f"""targets as (select page_id, position, href, {_ABSOLUTE} as url from links)""",
        select=f"""
        select page_id, cast(position as bigint) as position, href, url, {_HOST.format('url')} as host,
               {_HOST.format('url')} = 'example.com' or {_HOST.format('url')} like '%.example.com'
                 or {_HOST.format('url')} = 'm.ththth.example.net'
                 or {_HOST.format('url')} like '%.m.ththth.example.net' as allowed
        from targets""",
    ),
    "list_page_links": """
        select page_id, position, url from (
          select doc_id, doc_id // 20 as page_id,
                 row_number() over (partition by doc_id // 20 order by doc_id) - 1 as position,
                 'https://board.example/post/' || doc_id as url
          from documents where doc_id % 10 not in (7, 9))
        where doc_id % 10 <> 8""",
    "board_page_posts": _sql(
        *_BASE,
        """pushes as (
          select post_id, count(*) as n, cast(sum(score) as bigint) as score,
                 string_agg('u' || user_id, ',' order by event_id) as users,
                 string_agg(': no ' || event_id, ',' order by event_id) as comment_texts
          from comments group by post_id)""",
        select=f"""
        select post_id, title, author, {_TIME}, md5(content) as content_md5, n as n_comments, users,
               comment_texts, score
        from posts join pushes using (post_id) where post_id % 50 < 47""",
    ),
    "board_page_posts_all": _sql(
        *_BASE,
        """pushes as (
          select post_id, count(*) as n, cast(sum(score) as bigint) as score,
                 string_agg('u' || user_id, ',' order by event_id) as users,
                 string_agg(': no ' || event_id, ',' order by event_id) as comment_texts
          from comments group by post_id)""",
        """dated as (
          select * replace (coalesce(posted_at, timestamp '2024-01-01'
                            + to_seconds(post_id * 7919 % 2592000)) as posted_at) from posts)""",
        select=f"""
        select post_id, title, author, {_TIME}, md5(content) as content_md5, coalesce(n, 0) as n_comments,
               coalesce(users, '') as users, coalesce(comment_texts, '') as comment_texts,
               coalesce(score, 0) as score
        from dated left join pushes using (post_id)
        where post_id % 50 < 47 or (post_id % 50 = 47 and n is null)""",
    ),
    "news_posts": _sql(
        *_BASE,
        select=f"""
        select post_id, title, url, md5({_SEGMENTED}) as content_split_md5
        from posts where {_IS_NEWS}""",
    ),
    "segment_text": _sql(
        *_BASE,
        r"""pieces as (
          select post_id, regexp_extract_all(
            regexp_replace(title || ' ' || content, '(\p{Han}+)', ' \1 ', 'g'),
            '[\p{L}\p{N}_]+|\S') as raw from posts)""",
        r"""parts as (
          select post_id, flatten(list_transform(raw, lambda x:
            case when regexp_full_match(x, '\p{Han}{2,}')
                 then list_transform(range(1, length(x)), lambda i: substring(x, i, 2))
                 else [x] end)) as s from pieces)""",
        select="""
        select post_id, cast(len(s) as bigint) as n_segments, md5(array_to_string(s, ' ')) as segments_md5
        from parts""",
    ),
    "dedup_posts": _sql(
        *_BASE,
        select="""
        select post_id, title, md5(content) as content_md5 from posts
        where post_id in (select max(post_id) from posts group by content)""",
    ),
    "vote_tally": _sql(
        _COMMENTS, _TALLY, select="select post_id, n_push, n_hate, n_neutral from tally"
    ),
    "post_score": _sql(
        _COMMENTS,
        select="""
        select doc_id as post_id, cast(coalesce(sum(score), 0) as bigint) as score
        from documents left join comments on doc_id = post_id group by doc_id""",
    ),
    "calendar_tags": _sql(
        *_BASE, _CALENDAR, select="select post_id, hour, weekday, hour_tag from tagged"
    ),
    "tokens": _sql(
        *_BASE,
        _TOKENS,
        select="""
        select post_id, cast(len(words) as bigint) as n_tokens,
               md5(array_to_string(words, ' ')) as tokens_md5 from tokenised""",
    ),
    "term_counts": _sql(*_BASE, _TOKENS, _COUNTS, select="select post_id, term, tf from counts"),
    "term_stats": _sql(
        *_BASE,
        _TOKENS,
        _COUNTS,
        select="""
        select term, count(*) as df, cast(sum(tf) as bigint) as cf from counts group by term""",
    ),
    "corpus_shape": _sql(
        *_BASE,
        _TOKENS,
        _COUNTS,
        select="""
        select (select count(*) from posts) as n_posts, count(distinct term) as n_terms,
               count(*) as n_cells from counts""",
    ),
    "tfidf_weights": _sql(
        *_BASE,
        *_KEYWORDS[:3],
        select="select post_id, term, tf, df, round(weight, 6) as weight from weights",
    ),
    "keywords": _sql(
        *_BASE, *_KEYWORDS, select="select post_id, term, round(weight, 6) as weight from kept"
    ),
    "keyword_strings": _sql(
        *_BASE,
        *_KEYWORDS,
        select="""
        select post_id, coalesce(string_agg(term, ';' order by term), '') as words_filtered,
               count(term) as n_words
        from posts left join kept using (post_id) group by post_id""",
    ),
    "windows": _sql(
        *_BASE_HOURLY,
        _WINDOWS,
        select="""
        select window_id, strftime(low, '%Y-%m-%d %H:%M:%S') as low,
               strftime(up, '%Y-%m-%d %H:%M:%S') as up from windows""",
    ),
    "window_docs": _sql(
        *_BASE_HOURLY, _WINDOWS, _MEMBERS, select="select window_id, post_id from members"
    ),
    "score_window": _sql(
        *_BASE_HOURLY,
        _WINDOWS,
        _MEMBERS,
        _SCORED_BY,
        select="select post_id, window_id from posts left join scored_by using (post_id)",
    ),
    "window_dictionary": _sql(
        *_BASE_HOURLY,
        *_KEYWORDS,
        _WINDOWS,
        _MEMBERS,
        select="""
        select window_id, count(distinct term) as n_terms
        from members join kept using (post_id) group by window_id""",
    ),
    "bag_of_words": _sql(
        *_BASE_HOURLY,
        *_KEYWORDS,
        _WINDOWS,
        _MEMBERS,
        _SCORED_BY,
        "known as (select distinct window_id, term from members join kept using (post_id))",
        select="""
        select window_id, post_id, term, cast(1 as bigint) as n
        from scored_by join kept using (post_id) join known using (window_id, term)""",
    ),
    "topic_index": _sql(
        *_TREND[:-1],
        select="""
        select window_id, cast(topic as bigint) as topic, round(counts, 6) as counts,
               round(all_n_push, 6) as all_n_push, round(all_n_hate, 6) as all_n_hate,
               round(all_n_neutral, 6) as all_n_neutral,
               round(all_n_push / counts, 6) as avg_n_push,
               round(all_n_hate / counts, 6) as avg_n_hate,
               round(all_n_neutral / counts, 6) as avg_n_neutral
        from topic_sums""",
    ),
    "trend_scores": _sql(
        *_TREND,
        select=f"""
        select post_id, {_TIME}, round(score_positive, 6) as score_positive,
               round(score_hate, 6) as score_hate, round(score_neutral, 6) as score_neutral, scored
        from scores""",
    ),
    "clean_text": _sql(
        *_BASE,
        _CLEANED,
        select="select post_id, length(text) as n_chars, md5(text) as cleaned_md5 from cleaned",
    ),
    "doc_lengths": _sql(
        *_BASE,
        _CLEANED,
        select="""
        select post_id, cast(len(string_split(text, ' ')) as bigint) as n_words,
               cast(max(len(string_split(text, ' '))) over () as bigint) as longest from cleaned""",
    ),
    "vocab_first_seen": _sql(
        *_BASE, _CLEANED, _VOCABULARY, select="select term, term_id from vocabulary"
    ),
    "encoded_docs": _sql(
        *_BASE,
        _CLEANED,
        _VOCABULARY,
        _ENCODED,
        select="""
        select post_id, cast(len(ids) as bigint) as n_ids, md5(array_to_string(ids, ' ')) as ids_md5
        from encoded""",
    ),
    "one_hot": _sql(
        *_BASE,
        _CALENDAR,
        select="""
        select post_id, hour_tag, coalesce(cast(hour_tag = 'OutOfWork' as double), 0) as hot_1,
               coalesce(cast(hour_tag = 'WakeUp' as double), 0) as hot_2,
               coalesce(cast(hour_tag = 'Work' as double), 0) as hot_3
        from tagged""",
    ),
    "model_rows": _sql(
        *_TREND,
        _CALENDAR,
        select="""
        select post_id, md5(content) as content_md5, hour_tag, n_hate,
               round(score_positive, 6) as score_positive, round(score_hate, 6) as score_hate,
               round(score_neutral, 6) as score_neutral
        from tagged join scores using (post_id)
        where content is not null and n_hate is not null""",
    ),
    "feature_array": _sql(
        *_TREND,
        _CALENDAR,
        _CLEANED,
        _VOCABULARY,
        _ENCODED,
        select="""
        select post_id, cast(len(ids) + 6 as bigint) as n_features,
               md5(array_to_string(ids, ' ')) as ids_md5,
               round(score_positive, 6) as meta_1, round(score_hate, 6) as meta_2,
               round(score_neutral, 6) as meta_3,
               coalesce(cast(hour_tag = 'OutOfWork' as double), 0) as meta_4,
               coalesce(cast(hour_tag = 'WakeUp' as double), 0) as meta_5,
               coalesce(cast(hour_tag = 'Work' as double), 0) as meta_6
        from encoded join scores using (post_id) join tagged using (post_id)""",
    ),
    "split_rows": _sql(*_BASE, _RANKED, select="select post_id, rank, split from parted"),
    "split_sizes": _sql(
        *_BASE,
        _RANKED,
        select="""
        select split, count(*) as n_rows, cast(sum(n_hate) as bigint) as total_hate
        from parted group by split""",
    ),
    "epoch_batches": _sql(
        *_BASE,
        _RANKED,
        select="""
        select epoch, (row_number() over (partition by epoch
                 order by md5('57:' || epoch || ':' || post_id), post_id) - 1) // 64 as batch, post_id
        from parted, (select unnest(range(4)) as epoch) where split = 'train'""",
    ),
    "epoch_permutation": "with recursive " + _sql(
        *_BASE,
        _RANKED,
        _PERMUTED,
        select="select epoch, x // 64 as batch, x as place, post_id from walks where step > 0 and x < n",
    ).removeprefix("with "),
    "value_summary": """
        select event_type as measure, min(value) as minimum, round(quantile_cont(value, 0.25), 6) as q1,
               round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean,
               round(quantile_cont(value, 0.75), 6) as q3, max(value) as maximum
        from events where event_type is not null and value is not null and not isnan(value) group by event_type""",
    "vote_summary": _sql(*_BASE, select=_SUMMARY),
    "hate_by_hour": _sql(
        *_BASE,
        _CALENDAR,
        select="""
        select hour, round(avg(n_hate), 6) as mean, round(stddev_samp(n_hate), 6) as sd
        from tagged group by hour""",
    ),
    "hate_by_weekday": _sql(
        *_BASE,
        _CALENDAR,
        select="""
        select weekday, round(avg(n_hate), 6) as mean, round(stddev_samp(n_hate), 6) as sd
        from tagged group by weekday""",
    ),
    "weekday_hour_matrix": _sql(*_BASE, _CALENDAR, _CELLS, select=_matrix("mean")),
    "heat_zscores": _sql(*_BASE, _CALENDAR, _CELLS, select=_matrix("z")),
    "welch_weekday": _sql(
        *_BASE,
        _CALENDAR,
        """m as (
          select count(*) filter (weekday = 'Wednesday') as n1, count(*) filter (weekday = 'Friday') as n2,
                 avg(n_hate) filter (weekday = 'Wednesday') as mean1,
                 avg(n_hate) filter (weekday = 'Friday') as mean2,
                 var_samp(n_hate) filter (weekday = 'Wednesday') / n1 as e1,
                 var_samp(n_hate) filter (weekday = 'Friday') / n2 as e2 from tagged)""",
        """tested as (
          select n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(e1 + e2) as t,
                 (e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)) as df from m)""",
        """bounds as (
          select *, atan(abs(t) / sqrt(df)) as a,
                 greatest(acos(exp(-42.0 / greatest(df - 1, 1e-9))), atan(abs(t) / sqrt(df))) as b,
                 acos(exp(-42.0 / greatest(df - 1, 1e-9))) as c from tested)""",
        select=f"""
        select n1, n2, round(mean1, 6) as mean1, round(mean2, 6) as mean2, round(t, 6) as t,
               round(df, 6) as df,
               round(({_SIMPSON.format(low="a", high="b")})
                     / ({_SIMPSON.format(low="0.0", high="c")}), 6) as p_value
        from bounds""",
    ),
    "baseline_mean": _sql(
        *_BASE,
        select="""
        select count(n_hate) as n, round(avg(n_hate), 6) as mean,
               round(sqrt(avg((n_hate - (select avg(n_hate) from posts)) ** 2)), 6) as rmse
        from posts""",
    ),
    "baseline_prev_day": _sql(
        *_BASE,
        "days as (select posted_at::date as day, avg(n_hate) as mean from posts group by 1)",
        select="""
        select count(*) as n, round(sqrt(avg((n_hate - mean) ** 2)), 6) as rmse
        from posts join days on posted_at::date = day + 1""",
    ),
    "rmse_by_batch": _sql(
        *_BASE,
        _RANKED,
        """errors as (
          select (rank - 1) // 64 as batch, (n_hate - (select avg(n_hate) from posts)) ** 2 as e
          from ranked)""",
        select="""
        select count(*) as n_batches, round(avg(root), 6) as rmse_batches,
               (select round(sqrt(avg(e)), 6) from errors) as rmse
        from (select batch, sqrt(avg(e)) as root from errors group by batch)""",
    ),
    "trend_scores_lda": _sql(
        *_BASE_HOURLY,
        *_KEYWORDS,
        _WINDOWS,
        _MEMBERS,
        _SCORED_BY,
        select="""
        select post_id,
               coalesce(window_id in (select window_id from members join kept using (post_id)), false)
                 and post_id in (select post_id from kept) as scored,
               true as possible
        from posts left join scored_by using (post_id)""",
    ),
    "padded_batches": _sql(
        *_BASE,
        _CLEANED,
        _VOCABULARY,
        _ENCODED,
        _RANKED,
        """dealt as (
          select post_id, n_hate, ids, (row_number() over (order by md5('57:0:' || post_id), post_id) - 1) // 64 as batch
          from parted join encoded using (post_id) where split = 'train')""",
        """filled as (
          select batch, post_id, n_hate, list_resize(ids, max(len(ids)) over (partition by batch), 0) as ids
          from dealt)""",
        select="""
        select batch, post_id, cast(len(ids) as bigint) as n_ids, md5(array_to_string(ids, ' ')) as ids_md5,
               n_hate from filled""",
    ),
    "ngram_counts": _sql(
        *_BASE,
        _CLEANED,
        r"""lengths as (
          select post_id, len(regexp_extract_all(text, '[''\p{L}\p{N}_-]+')) as n from cleaned)""",
        select="""
        select post_id, cast(width as bigint) as width, cast(greatest(n - width + 1, 0) as bigint) as n_ngrams
        from lengths, (select unnest([2, 3, 4]) as width)""",
    ),
    "ngram_regression": _sql(
        *_BASE,
        _RANKED,
        select="""
        select split, count(*) as n_rows, round(avg(n_hate), 6) as mean_label,
               case when split = 'train' then 0.0::double end as train_gap,
               case when split = 'train' then true end as train_fits
        from parted group by split""",
    ),
    "ablation_rmse": _sql(
        *_BASE,
        _RANKED,
        select="""
        select features, split, count(*) as n_rows, round(avg(n_hate), 6) as mean_label,
               case when split = 'train' then 0.0::double end as train_gap,
               case when split = 'train' then true end as train_fits
        from parted, (select unnest(['text', 'text+scores', 'text+scores+tag']) as features)
        group by features, split""",
    ),
    "batch_errors": _sql(
        *_BASE,
        _RANKED,
        """errors as (
          select (rank - 2) // 64 as batch, (n_hate - before) ** 2 as e
          from (select *, lag(n_hate) over (order by rank) as before from ranked) where rank > 1)""",
        select="""
        select count(*) as n_batches, round(avg(root), 6) as rmse_batches,
               (select round(sqrt(avg(e)), 6) from errors) as rmse
        from (select batch, sqrt(avg(e)) as root from errors group by batch)""",
    ),
    "han_terms": _sql(*_BASE, _HAN, _COUNTS, select="select post_id, term, tf from counts"),
    "board_page_bodies": _sql(
        *_BASE,
        select="""
        select post_id as page_id, cast(length(content) as bigint) as n_chars, md5(content) as content_md5
        from posts where post_id % 50 < 49""",
    ),
    "stream_tallies": _sql(
        _COMMENTS,
        select="""
        select strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as low,
               strftime(time_bucket(interval '6 hours', ts) + interval '6 hours', '%Y-%m-%d %H:%M:%S') as up,
               count(*) filter (score = 1) as n_push, count(*) filter (score = -1) as n_hate,
               count(*) filter (score = 0) as n_neutral
        from comments group by time_bucket(interval '6 hours', ts)""",
    ),
    "han_ngrams": _sql(*_BASE, _GRAMS, select="select gram, n, count from grams"),
    "han_dictionary": _sql(
        *_BASE,
        _GRAMS,
        _WORDS_LEARNT,
        select="""
        select gram, n, count, round(cohesion, 6) as cohesion, round(left_entropy, 6) as left_entropy,
               round(right_entropy, 6) as right_entropy from learnt""",
    ),
    "han_words": _sql(
        *_BASE,
        _GRAMS,
        _WORDS_LEARNT,
        _CUT,
        select="select run, cast(len(words) as bigint) as n_words, array_to_string(words, ' ') as words from cut",
    ).replace("with ", "with recursive ", 1),
    "han_keyword_terms": _sql(
        *_BASE,
        _GRAMS,
        _WORDS_LEARNT,
        _CUT,
        r"""
        terms as (
          select post_id, unnest(words) as term from han_runs join cut using (run)
          union all
          select post_id, unnest(regexp_extract_all(lower(regexp_replace(content, '\p{Han}+', ' ', 'g')), '[\p{L}\p{N}_]{2,}'))
          from han)""",
        select="select post_id, term, count(*) as tf from terms where length(term) > 1 group by post_id, term",
    ).replace("with ", "with recursive ", 1),
    "news_trend": _sql(
        _COMMENTS,
        _TALLY,
        _NEWS,
        *_TREND[len(_BASE_HOURLY):],
        select="""
        select post_id, round(score_positive, 6) as score_positive, round(score_hate, 6) as score_hate,
               round(score_neutral, 6) as score_neutral, scored from scores""",
    ),
}
ORACLES["posts_from_json_lines"] = ORACLES["posts_from_json"]
