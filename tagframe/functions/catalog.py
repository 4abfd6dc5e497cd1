"""Catalogues of codes and names, and the sizes of value types.

Catalogues are constants of at most 52 rows, so joining one is always a broadcast
of known size; ``name_of`` and ``code_of`` need no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag names and codes, in the order of their declaration, which is also their sort order.
TAGS = (
    ("Artist", 315), ("BitsPerSample", 258), ("CellLength", 265), ("CellWidth", 264), ("ColorMap", 320),
    ("Compression", 259), ("Copyright", 33432), ("DateTime", 306), ("ExtraSamples", 338), ("FillOrder", 266),
    ("FreeByteCounts", 289), ("FreeOffsets", 288), ("GrayResponseCurve", 291), ("GrayResponseUnit", 290),
    ("HostComputer", 316), ("ImageDescription", 270), ("ImageLength", 257), ("ImageWidth", 256), ("Make", 271),
    ("MaxSampleValue", 281), ("MinSampleValue", 280), ("Model", 272), ("NewSubfileType", 254), ("Orientation", 274),
    ("PhotometricInterpretation", 262), ("PlanarConfiguration", 284), ("ResolutionUnit", 296), ("RowsPerStrip", 278),
    ("SamplesPerPixel", 277), ("Software", 305), ("StripByteCounts", 279), ("StripOffsets", 273), ("SubfileType", 255),
    ("Threshholding", 263), ("XResolution", 282), ("YResolution", 283), ("Predictor", 317), ("TileWidth", 322),
    ("TileLength", 323), ("TileOffsets", 324), ("TileByteCounts", 325), ("SampleFormat", 339), ("SMinSampleValue", 340),
    ("SMaxSampleValue", 341), ("JPEGTables", 347), ("ModelPixelScaleTag", 33550), ("ModelTransformationTag", 34264),
    ("ModelTiepointTag", 33922), ("GeoKeyDirectoryTag", 34735), ("GeoDoubleParamsTag", 34736),
    ("GeoAsciiParamsTag", 34737), ("GdalNodata", 42113),
)

# Value types as name, code, bytes of an element, bytes that are swapped together.
TYPES = (
    ("BYTE", 1, 1, 1), ("ASCII", 2, 1, 1), ("SHORT", 3, 2, 2), ("LONG", 4, 4, 4), ("RATIONAL", 5, 8, 4),
    ("SBYTE", 6, 1, 1), ("UNDEFINED", 7, 1, 1), ("SSHORT", 8, 2, 2), ("SLONG", 9, 4, 4), ("SRATIONAL", 10, 8, 4),
    ("FLOAT", 11, 4, 4), ("DOUBLE", 12, 8, 8), ("IFD", 13, 4, 4), ("LONG8", 16, 8, 8), ("SLONG8", 17, 8, 8), ("IFD8", 18, 8, 8),
)

# The other enumerations.
ENUMS: dict[str, tuple[tuple[str, int], ...]] = {
    "Tag": TAGS,
    "TagType": tuple((n, c) for n, c, _, _ in TYPES),
    "CompressionMethod": (
        ("None", 1), ("Huffman", 2), ("Fax3", 3), ("Fax4", 4), ("LZW", 5), ("JPEG", 6), ("ModernJPEG", 7), ("Deflate", 8), ("OldDeflate", 32946), ("PackBits", 32773),
    ),
    "PhotometricInterpretation": (
        ("WhiteIsZero", 0), ("BlackIsZero", 1), ("RGB", 2), ("RGBPalette", 3), ("TransparencyMask", 4), ("CMYK", 5), ("YCbCr", 6), ("CIELab", 8),
    ),
    "PlanarConfiguration": (("Chunky", 1), ("Planar", 2)),
    "Predictor": (("None", 1), ("Horizontal", 2), ("FloatingPoint", 3)),
    "ResolutionUnit": (("None", 1), ("Inch", 2), ("Centimeter", 3)),
    "SampleFormat": (("Uint", 1), ("Int", 2), ("IEEEFP", 3), ("Void", 4)),
}

#: Enumerations that have a value for every code.
EXHAUSTIVE = ("Tag", "CompressionMethod", "SampleFormat")

TAG = {name: code for name, code in TAGS}
TYPE = {name: code for name, code, _, _ in TYPES}
UNSIGNED = tuple(TYPE[n] for n in ("BYTE", "SHORT", "LONG", "IFD", "LONG8", "IFD8"))
SIGNED = tuple(TYPE[n] for n in ("SBYTE", "SSHORT", "SLONG", "SLONG8"))
OFFSET_TYPES = (TYPE["IFD"], TYPE["IFD8"])


def _switch(code: Column, by_value: dict) -> Column:
    """CASE over codes; codes of one value share a branch."""
    groups: dict[object, list] = {}
    for key, value in by_value.items():
        groups.setdefault(value, []).append(key)
    found = None
    for value, keys in groups.items():
        when = code.isin(keys) if len(keys) > 1 else code == F.lit(keys[0])
        found = F.when(when, F.lit(value)) if found is None else found.when(when, F.lit(value))
    return found


def name_of(enum: str, code: Column) -> Column:
    """The name of a code; null for an unknown one."""
    return _switch(code, {c: n for n, c in ENUMS[enum]})


def name_or_unknown(enum: str, code: Column) -> Column:
    """The name of a code, or Unknown(code); for enumerations with a value for every code."""
    if enum not in EXHAUSTIVE:
        raise ValueError(f"{enum} has no value for unknown codes")
    return F.coalesce(name_of(enum, code), F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")")))


def code_of(enum: str, name: Column) -> Column:
    """The code of a name, Unknown(n) included where that exists; null for another name."""
    known = _switch(name, {n: c for n, c in ENUMS[enum]})
    if enum not in EXHAUSTIVE:
        return known
    return F.coalesce(known, F.nullif(F.regexp_extract(name, r"^Unknown\((\d+)\)$", 1), F.lit("")).cast("int"))


def size_of(type_code: Column) -> Column:
    """Bytes of an element; null for an unknown type."""
    return _switch(type_code, {c: s for _, c, s, _ in TYPES})


def swap_unit_of(type_code: Column) -> Column:
    """Bytes that byte order reverses together: a rational is two numbers of 4."""
    return _switch(type_code, {c: p for _, c, _, p in TYPES})


def catalog(spark: SparkSession, enum: str) -> DataFrame:
    """name, code, decl_order (and size, swap_unit for TagType) as a table."""
    rows = [(n, c, k) for k, (n, c) in enumerate(ENUMS[enum])]
    df = spark.createDataFrame(rows, "name string, code int, decl_order int")
    if enum == "TagType":
        df = df.withColumns({"size": size_of(F.col("code")), "swap_unit": swap_unit_of(F.col("code"))})
    return df


#: Colour types and the numbers that their payloads hold.
COLOR_TYPES = ("Gray", "RGB", "Palette", "GrayA", "RGBA", "CMYK", "YCbCr", "Multiband")


def color_type(kind: Column, bit_depth: Column, num_samples: Column | None = None) -> Column:
    """STRUCT<kind, bit_depth, num_samples>; only Multiband has num_samples, an unknown kind gives null."""
    samples = F.when(kind == "Multiband", num_samples) if num_samples is not None else F.lit(None)
    return F.when(kind.isin(*COLOR_TYPES), F.struct(kind.alias("kind"), bit_depth.cast("int").alias("bit_depth"), samples.cast("int").alias("num_samples")))


def bit_depth(color: Column) -> Column:
    return color["bit_depth"]
