"""Scalar functions of the archive as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Named entities by their characters; the ampersand must come last.
NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")]


def slugify(tag: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; 't-' and the first 12 hex digits of the bytes where none is left."""
    base = F.btrim(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(base != "", base).otherwise(F.concat(F.lit("t-"), F.substring(F.lower(F.hex(F.encode(tag, "UTF-8"))), 1, 12)))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def _code_points(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities to characters; invalid code points stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def put(done: Column, digits: Column) -> Column:
        n = F.conv(digits, base, 10).cast("bigint")
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(63))), 8, "0")), "UTF-32")
        entity = F.concat(F.lit("&#x" if base == 16 else "&#"), digits, F.lit(";"))
        return F.when(valid, F.replace(done, entity, char)).otherwise(done)

    return F.aggregate(F.array_distinct(pieces), text, put)


def decode_entities(text: Column, rounds: int = 6) -> Column:
    """Decimal, hexadecimal and named entities, again until nothing changes, ``rounds`` times at most."""

    def once(s: Column) -> Column:
        s = _code_points(s, "&#([0-9]{1,7});", 10)
        s = _code_points(s, "&#x([0-9A-Fa-f]{1,6});", 16)
        for name, char in NAMED:
            s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
        return F.replace(s, F.lit("&amp;"), F.lit("&"))

    # what no round changes is only looked at
    some = "&(?:#[0-9]{1,7};|#x[0-9A-Fa-f]{1,6};|(?:" + "|".join(name for name, _ in (*NAMED, ("amp", "&"))) + ");)"
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, lambda s, _: F.when(F.contains(s, F.lit("&")) & s.rlike(some), once(s)).otherwise(s))


def title(subject: Column, body: Column, most: int = 70) -> Column:
    """The subject, or an excerpt of the body that ends at a whole word."""
    flat = squeeze(decode_entities(strip_tags(F.coalesce(body, F.lit("")))))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    excerpt = F.when(flat == "", F.lit("(no subject)")).when(F.length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)
    return F.when(F.btrim(F.coalesce(subject, F.lit(""))) != "", subject).otherwise(excerpt)


def parts(stamp: Column) -> dict[str, Column]:
    """Year, month, day and hour of 'yyyy-mm-dd hh:mm'; 0, 1, 1 and '00' where it isn't one."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}))?"
    number = lambda k, other: F.coalesce(F.regexp_extract(stamp, pattern, k).try_cast("int"), F.lit(other))
    hour = F.regexp_extract(stamp, pattern, 4)
    return {"y": number(1, 0), "m": number(2, 1), "d": number(3, 1), "hh": F.when(F.coalesce(hour, F.lit("")) == "", F.lit("00")).otherwise(hour)}


def split_music(raw: Column) -> tuple[Column, Column]:
    """(artist, song): 'artist - song', else 'song by artist', else the artist alone."""
    text = F.btrim(raw)
    dash = F.instr(text, " - ")
    by = F.locate(" by ", F.lower(text))
    head = lambda at: F.btrim(F.substr(text, F.lit(1), at - 1))
    tail = lambda at, n: F.btrim(F.substr(text, at + n))
    artist = F.when(dash > 1, head(dash)).when(by > 1, tail(by, 4)).otherwise(text)
    song = F.when(dash > 1, tail(dash, 3)).when(by > 1, head(by))
    return artist, F.nullif(song, F.lit(""))


def music_key(name: Column) -> Column:
    """One key for the spellings of a name: lower case, without a leading 'the', letters and digits only."""
    low = F.replace(F.lower(name), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(low, r"^\s*the\s+", ""), "[^a-z0-9]", "")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def words(html: Column) -> Column:
    return F.size(F.filter(F.split(strip_tags(html), r"\s+"), lambda w: w != "")).cast("bigint")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def self_item(url: Column, host: Column) -> Column:
    """The number of an own page, '/<digits>.html' on the own host."""
    found = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/(\d+)\.html$", 1)
    return F.when(host_of(url) == host, F.nullif(found, F.lit("")).try_cast("bigint"))


def repair_scheme(url: Column) -> Column:
    bare = url.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([/?#:]|$)") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when(bare, F.concat(F.lit("http://"), url)).otherwise(url)


def escape_bogus_end_tags(html: Column) -> Column:
    return F.regexp_replace(html, "</(?![A-Za-z])", "&lt;/")


def is_image_link(url: Column) -> Column:
    return url.rlike(r"(?i)\.(jpe?g|png|gif|bmp|webp|tiff?)([?#]|$)")


def video_id(url: Column) -> Column:
    """The id in an embedding proxy's address, whose source must be the one video host that has posters."""
    query = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k))
    return F.when(query("source") == "youtube", F.nullif(query("vid"), F.lit("")))


def video_thumb(url: Column) -> Column:
    quoted = F.replace(F.url_encode(F.url_decode(video_id(url))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://img.youtube.com/vi/"), quoted, F.lit("/hqdefault.jpg"))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.btrim(t)), lambda t: t != "")


def one_of(value: Column, allowed: list[str], other: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def security(value: Column) -> Column:
    return one_of(value, ["public", "private", "usemask"], "public")


def comment_state(value: Column) -> Column:
    return one_of(value, ["A", "D", "S", "F"], "A")


def blob_path(digest: Column, ext: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("."), F.coalesce(ext, F.lit("bin")))


def heat(count: Column, peak: Column) -> Column:
    """0 to 3: none, some, a fifth of the peak, half of it."""
    return F.when(count == 0, 0).when(count * 2 >= peak, 3).when(count * 5 >= peak, 2).otherwise(1)


def percent(part: Column, whole: Column) -> Column:
    return F.floor(part * 100 / F.greatest(whole, F.lit(1)) + 0.5).cast("bigint")


def days_between(later: Column, earlier: Column) -> Column:
    return F.round(F.timestamp_diff("SECOND", earlier, later) / 86400).cast("bigint")


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy — HH:mm")


def lost_label(tag: Column) -> Column:
    """What stands for a journal tag that can't be shown: a poll by its number, a template, or the tag's name."""
    poll = F.regexp_extract(tag, r"^lj-poll-(\d+)$", 1)
    return F.when(poll != "", F.concat(F.lit("poll "), poll)).when(tag == "lj-template", F.lit("template")).otherwise(F.regexp_replace(tag, "^lj-", ""))


def page_path(kind: str, *args: Column) -> Column:
    """Where a page of the site stands."""
    if kind == "entry":
        return F.concat(F.lit("entries/"), args[0].cast("string"), F.lit(".html"))
    if kind == "day":
        return F.concat(F.lit("days/"), args[0], F.lit(".html"))
    return F.concat(F.lit(f"{kind}/"), args[0].cast("string"), F.lit(".html"))


def root_for(path: Column) -> Column:
    return F.repeat(F.lit("../"), F.size(F.split(path, "/")) - 1)
