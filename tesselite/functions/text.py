"""Addresses, hashes and JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselite.plans.spec import Profile

TILE_PREFIX = "/tiles/raster/"
SEGMENT = "[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}"


def _text(x: Column | str | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def short_sha(payload: Column, digits: int) -> Column:
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, digits)


def profile_hash(p: Profile) -> Column:
    return short_sha(F.lit(f"{p.metatile},{p.padding_blocks},{str(p.height_shade).lower()},{str(p.fluid_depth).lower()}"), 8)


def grid_version(p: Profile) -> Column:
    g = p.grid
    return F.lit(",".join(map(str, (g.tile_size, g.min_zoom, g.max_zoom, g.pixels_per_block, g.origin_x, g.origin_z, p.mode.value))))


def tileset_version(world: Column | str, dimension: Column | str, p: Profile) -> Column:
    """Content hash that names a tileset; any change to what is drawn or where gives another."""
    parts = [_text(world), _text(dimension), F.lit(p.profile_id), profile_hash(p), F.lit(p.pack_signature), F.lit(p.material_version), F.lit(p.renderer_version), grid_version(p), F.lit(p.format), F.lit(str(p.quality))]
    return short_sha(F.concat_ws("|", *parts), 16)


def is_segment(c: Column) -> Column:
    return c.rlike(rf"\A{SEGMENT}\z")


def is_dimension(c: Column) -> Column:
    return c.rlike(rf"\A{SEGMENT}(:{SEGMENT})?\z")


def is_extension(c: Column) -> Column:
    return c.rlike(r"\A[a-z0-9]{1,8}\z")


def is_asset_path(path: Column) -> Column:
    """Whether a path names a plain file: checked after decoding; a bad escape is no path."""
    decoded = F.try_url_decode(path)
    return F.coalesce(decoded.rlike(r"\A(/[A-Za-z0-9_-][A-Za-z0-9._-]*)+\z") & (F.length(decoded) <= 256), F.lit(False))


def encode_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/"), F.lit("%2F")), F.lit("\\"), F.lit("%5C"))


def safe_path_segment(c: Column) -> Column:
    return F.translate(c, ":/\\", "___")


def tile_url_template() -> str:
    return TILE_PREFIX + "{world}/{dimension}/{profile}/{tilesetVersion}/{z}/x{x}/y{y}"


def tile_url(world: Column, dimension: Column, profile: Column, version: Column, zoom: Column, x: Column, y: Column, extension: str = Profile.extension) -> Column:
    return F.concat(F.lit(TILE_PREFIX), F.concat_ws("/", *map(encode_segment, (world, dimension, profile, version)), _text(zoom), F.concat(F.lit("x"), _text(x)), F.concat(F.lit("y"), _text(y), F.lit(f".{extension}"))))


def client_tile_url(template: str, world: Column, version: Column, profile: Column, dimension: Column, z: Column, x: Column, y: Column) -> Column:
    """The template with the first place of each name filled; the world is URI-encoded."""
    # what a URI component keeps beside letters and digits differs from form encoding in these
    encoded = F.url_encode(world)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    values = {"{world}": encoded, "{tilesetVersion}": version, "{profile}": profile, "{dimension}": dimension, "{z}": _text(z), "{x}": _text(x), "{y}": _text(y)}
    places = sorted((template.index(name), name) for name in values if name in template)
    parts, at = [], 0
    for start, name in places:
        parts += [F.lit(template[at:start]), values[name]]
        at = start + len(name)
    return F.concat(*parts, F.lit(template[at:]))


def tile_path(version: Column, dimension: Column, zoom: Column, x: Column, y: Column, extension: str = Profile.extension) -> Column:
    """Where a tile's file lies under the output root."""
    return F.concat_ws("/", F.lit("tiles"), version, safe_path_segment(dimension), _text(zoom), F.concat(F.lit("x"), _text(x)), F.concat(F.lit("y"), _text(y), F.lit(f".{extension}")))


_TILE_URL = rf"\A{TILE_PREFIX}([^/]*)/([^/]*)/([^/]*)/([^/]*)/([+-]?[0-9]+)/x([+-]?[0-9]+)/y([+-]?[0-9]+)\.([^/.]+)/*\z"


def parse_tile_urls(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose path has the shape of a tile's URL and whose decoded parts are safe, with world, dimension, profile,
    version, zoom, x, y and extension.  Numbers must fit 32 bits.  Parts are decoded before they are checked."""
    text = {"world": 1, "dimension": 2, "profile": 3, "version": 4, "extension": 8}
    number = {"zoom": 5, "x": 6, "y": 7}
    shaped = rows.filter(F.col(column).rlike(_TILE_URL))
    cut = shaped.withColumns({n: F.try_url_decode(F.regexp_extract(column, _TILE_URL, k)) for n, k in text.items()} | {n: F.regexp_extract(column, _TILE_URL, k).try_cast("int") for n, k in number.items()})
    fine = is_segment(F.col("world")) & is_segment(F.col("profile")) & is_segment(F.col("version")) & is_dimension(F.col("dimension")) & is_extension(F.col("extension"))
    for n in number:
        fine = fine & F.col(n).isNotNull()
    return cut.filter(fine).withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")})


def query_parameter(query: Column, key: str) -> Column:
    """First value of a key in a query string, decoded; null without one."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{key}="))
    return F.try_url_decode(F.substring(F.try_element_at(pairs, F.lit(1)), F.lit(len(key) + 2), F.length(query)))


def content_type(path: Column) -> Column:
    # Media types by suffix.
    kinds = (
        (".html", "text/html; charset=utf-8"), (".js", "application/javascript; charset=utf-8"), (".mjs", "application/javascript; charset=utf-8"), (".css", "text/css; charset=utf-8"),
        (".svg", "image/svg+xml"), (".png", "image/png"), (".webp", "image/webp"), (".json", "application/json; charset=utf-8"),
    )
    out = F.lit("application/octet-stream")
    for suffix, kind in reversed(kinds):
        out = F.when(path.endswith(suffix), kind).otherwise(out)
    return out


def json_number(x: Column) -> Column:
    """A double as JSON text: 0 if not finite, whole numbers without a point, else four places."""
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = finite & (x == F.rint(x)) & (F.abs(x) < F.lit(1e15))
    safe = F.when(finite, x).otherwise(F.lit(0.0))
    return F.when(~finite, "0").when(whole, F.when(F.abs(safe) < F.lit(1e15), safe).otherwise(F.lit(0.0)).cast("long").cast("string")).otherwise(F.format_string("%.4f", safe))


def json_string(x: Column) -> Column:
    """A quoted string with the escapes JSON asks for; null stays the word null."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in range(0x20):
        if chr(code) not in "\n\r\t\b\f":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """An object of fields that are JSON text already, in this order."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def mime_type(data: Column) -> Column:
    riff, webp = F.substring(data, 1, 4) == F.lit(b"RIFF"), F.substring(data, 9, 4) == F.lit(b"WEBP")
    return F.when((F.octet_length(data) >= 12) & riff & webp, "image/webp").otherwise("image/png")
