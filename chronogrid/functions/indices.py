"""Spectral indices as programs of the cube language over band roles, and reflectance adjustments.

The formulas are those of the public literature.  Fixed values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import Cube, evaluate

#: name: formula over blue, green, red, rededge, nir, swir1, swir2
INDICES = {
    "ndvi": "nd(nir, red)",
    "gndvi": "nd(nir, green)",
    "bndvi": "nd(nir, blue)",
    "ndwi": "nd(green, nir)",
    "mndwi": "nd(green, swir1)",
    "ndmi": "nd(nir, swir1)",
    "nbr": "nd(nir, swir2)",
    "nbr2": "nd(swir1, swir2)",
    "ndsi": "nd(green, swir1)",
    "ndbi": "nd(swir1, nir)",
    "ndre": "nd(nir, rededge)",
    "vari": "(green - red) / (green + red - blue)",
    "gli": "(2 * green - red - blue) / (2 * green + red + blue)",
    "evi": "2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)",
    "evi2": "2.5 * (nir - red) / (nir + 2.4 * red + 1)",
    "savi": "1.5 * (nir - red) / (nir + red + 0.5)",
    "osavi": "(nir - red) / (nir + red + 0.16)",
    "msavi": "(2 * nir + 1 - sqrt((2 * nir + 1) ^ 2 - 8 * (nir - red))) / 2",
    "arvi": "(nir - (2 * red - blue)) / (nir + (2 * red - blue))",
    "sipi": "(nir - blue) / (nir - red)",
    "dvi": "nir - red",
    "rvi": "nir / red",
    "ipvi": "nir / (nir + red)",
    "wdrvi": "(0.1 * nir - red) / (0.1 * nir + red)",
    "nirv": "nir * nd(nir, red)",
    "kndvi": "tanh(nd(nir, red) ^ 2)",
    "cvi": "nir * red / green ^ 2",
    "cig": "nir / green - 1",
    "cire": "nir / rededge - 1",
    "mcari": "((rededge - red) - 0.2 * (rededge - green)) * (rededge / red)",
    "tgi": "0 - 0.5 * (190 * (red - green) - 120 * (red - blue))",
    "bsi": "((swir1 + red) - (nir + blue)) / ((swir1 + red) + (nir + blue))",
    "awei": "4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)",
    "aweish": "blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2",
    "wri": "(green + red) / (nir + swir1)",
    "bai": "1 / ((0.1 - red) ^ 2 + (0.06 - nir) ^ 2)",
    "mirbi": "10 * swir2 - 9.8 * swir1 + 2",
    "gvmi": "((nir + 0.1) - (swir2 + 0.02)) / ((nir + 0.1) + (swir2 + 0.02))",
    "msi": "swir1 / nir",
    "ui": "nd(swir2, nir)",
    "ibi": "(nd(swir1, nir) - (1.5 * (nir - red) / (nir + red + 0.5) + nd(green, swir1)) / 2) / (nd(swir1, nir) + (1.5 * (nir - red) / (nir + red + 0.5) + nd(green, swir1)) / 2)",
    "ndti": "nd(red, green)",
    "ndyi": "nd(green, blue)",
    "si": "((1 - blue) * (1 - green) * (1 - red)) ^ (1 / 3)",
    "gemi": "(2 * (nir ^ 2 - red ^ 2) + 1.5 * nir + 0.5 * red) / (nir + red + 0.5) * (1 - 0.25 * ((2 * (nir ^ 2 - red ^ 2) + 1.5 * nir + 0.5 * red) / (nir + red + 0.5))) - (red - 0.125) / (1 - red)",
    "brightness_index": "sqrt((red ^ 2 + green ^ 2) / 2)",
    "ngrdi": "nd(green, red)",
    "rgbvi": "(green ^ 2 - blue * red) / (green ^ 2 + blue * red)",
    "mgrvi": "(green ^ 2 - red ^ 2) / (green ^ 2 + red ^ 2)",
    "exg": "2 * green - red - blue",
    "exr": "1.3 * red - green",
    "exgr": "2 * green - red - blue - (1.3 * red - green)",
    "rcc": "red / (red + green + blue)",
    "gcc": "green / (red + green + blue)",
    "bcc": "blue / (red + green + blue)",
    "ikaw": "nd(red, blue)",
    "gdvi": "nir - green",
    "gbndvi": "(nir - (green + blue)) / (nir + (green + blue))",
    "grndvi": "(nir - (green + red)) / (nir + (green + red))",
    "rbndvi": "(nir - (red + blue)) / (nir + (red + blue))",
    "pndvi": "(nir - (green + red + blue)) / (nir + (green + red + blue))",
    "gosavi": "(nir - green) / (nir + green + 0.16)",
    "gsavi": "1.5 * (nir - green) / (nir + green + 0.5)",
    "gari": "(nir - (green - (blue - red))) / (nir - (green + (blue - red)))",
    "msr": "(nir / red - 1) / sqrt(nir / red + 1)",
    "rdvi": "(nir - red) / sqrt(nir + red)",
    "nli": "(nir ^ 2 - red) / (nir ^ 2 + red)",
    "mnli": "1.5 * (nir ^ 2 - red) / (nir ^ 2 + red + 0.5)",
    "tvi": "sqrt(nd(nir, red) + 0.5)",
    "avi": "(nir * (1 - red) * (nir - red)) ^ (1 / 3)",
    "sarvi2": "2.5 * (nir - red) / (1 + nir + 6 * red - 7.5 * blue)",
    "fcvi": "nir - (red + green + blue) / 3",
    "mcari1": "1.2 * (2.5 * (nir - red) - 1.3 * (nir - green))",
    "mcari2": "1.5 * (2.5 * (nir - red) - 1.3 * (nir - green)) / sqrt((2 * nir + 1) ^ 2 - (6 * nir - 5 * sqrt(red)) - 0.5)",
    "mtvi1": "1.2 * (1.2 * (nir - green) - 2.5 * (red - green))",
    "tcari": "3 * ((rededge - red) - 0.2 * (rededge - green) * (rededge / red))",
    "ndii": "nd(nir, swir1)",
    "lswi": "nd(nir, swir1)",
    "nmdi": "(nir - (swir1 - swir2)) / (nir + (swir1 - swir2))",
    "ndpi": "(nir - (0.74 * red + 0.26 * swir1)) / (nir + (0.74 * red + 0.26 * swir1))",
    "wi2": "nd(blue, swir2)",
    "wi2015": "1.7204 + 171 * green + 3 * red - 70 * nir - 45 * swir1 - 71 * swir2",
    "andwi": "(blue + green + red - nir - swir1 - swir2) / (blue + green + red + nir + swir1 + swir2)",
    "swm": "(blue + green) / (nir + swir1)",
    "s3": "(nir * (red - swir1)) / ((nir + red) * (nir + swir1))",
    "swi": "(green * (nir - swir1)) / ((green + nir) * (nir + swir1))",
    "ndglai": "nd(green, red)",
    "ndsii": "nd(green, nir)",
    "csi": "nir / swir2",
    "baim": "1 / ((0.05 - nir) ^ 2 + (0.2 - swir2) ^ 2)",
    "nbr_plus": "(swir2 - nir - green - blue) / (swir2 + nir + green + blue)",
    "baei": "(red + 0.3) / (green + swir1)",
    "nbai": "(swir2 - swir1 / green) / (swir2 + swir1 / green)",
    "vibi": "nd(nir, red) / (nd(nir, red) + nd(swir1, nir))",
    "dbsi": "nd(swir1, green) - nd(nir, red)",
    "mbi": "(swir1 - swir2 - nir) / (swir1 + swir2 + nir) + 0.5",
    "nsds": "nd(swir1, swir2)",
    "ndsoi": "nd(swir2, green)",
    "bixs": "((green ^ 2 + red ^ 2) / 2) ^ 0.5",
    "ri4xs": "red ^ 2 / green ^ 4",
}

#: Band roles: code, words of band names that mean it (lower-case, without spaces), and its wavelengths in nm.  Fixed values.
ROLES = {
    "A": (("coastal", "aerosol", "aerosols", "ultrablue"), 400, 455),
    "B": (("blue",), 450, 530),
    "G": (("green",), 510, 600),
    "G1": (("green1", "green05"), 510, 550),
    "Y": (("yellow",), 585, 625),
    "R": (("red",), 620, 690),
    "RE1": (("rededge1", "re1", "rededge071", "rededge70"), 695, 715),
    "RE2": (("rededge2", "re2", "rededge075", "rededge74"), 730, 750),
    "RE3": (("rededge3", "re3", "rededge078", "rededge78"), 765, 795),
    "N": (("nir", "nir1", "nearinfrared"), 760, 900),
    "N2": (("nir2", "nir08", "narrownir", "nirnarrow"), 850, 880),
    "WV": (("wv", "watervapour", "watervapor", "nir09"), 930, 960),
    "S1": (("swir1", "swir16", "swir161"), 1550, 1750),
    "S2": (("swir2", "swir22", "swir220"), 2080, 2350),
    "T": (("thermal", "lwir", "tir", "stb10", "brightness"), 10400, 12500),
    "T1": (("thermal1", "lwir11", "tir1", "st_b10"), 10600, 11190),
    "T2": (("thermal2", "lwir12", "tir2"), 11500, 12510),
    "VV": (("vv",), 0, 0),
    "VH": (("vh",), 0, 0),
    "HH": (("hh",), 0, 0),
    "HV": (("hv",), 0, 0),
}
#: Names that the formulas above use, by role.
NAMES_OF_ROLES = {"blue": ("B",), "green": ("G", "G1"), "red": ("R",), "rededge": ("RE1",), "nir": ("N", "N2"), "swir1": ("S1",), "swir2": ("S2",)}

#: Centres in nm of the pairs of the fixed normalised differences, for cubes of many bands, and how far bands may be.  Fixed values.
WAVELENGTHS = {"ndvi": (860, 650, 50), "ndre": (790, 720, 15), "ndwi": (560, 860, 50), "ndmi": (860, 1650, 60), "nbr": (860, 2200, 60), "ndsi": (560, 1650, 60), "pri": (531, 570, 6)}

#: Parameters of the kernels by which reflectance varies with view and sun: isotropic, geometric, volumetric (Roy and others 2016).  Fixed values.
BRDF = {"blue": (0.0774, 0.0079, 0.0372), "green": (0.1306, 0.0178, 0.0580), "red": (0.1690, 0.0227, 0.0574), "nir": (0.3093, 0.0330, 0.1535), "swir1": (0.3430, 0.0453, 0.1154), "swir2": (0.2658, 0.0387, 0.0639)}


def index(cube: Cube, name: str, roles: dict[str, str] | None = None) -> DataFrame:
    """An index of the catalogue over a cube; `roles` names the bands that stand for blue, green and so on."""
    if name not in INDICES:
        raise ValueError(f"no index {name!r}; there are {', '.join(INDICES)}")
    named = Cube(cube.rows.withColumnsRenamed({v: k for k, v in (roles or {}).items()}), cube.keys, cube.ts)
    return evaluate(named, INDICES[name], name)


def band_of_role(bands: dict[str, float | None], code: str) -> str | None:
    """The band that has a role: one whose name is a word for it, or the one whose centre (nm; none if unknown) lies nearest to the middle of the role's wavelengths."""
    words, lo, hi = ROLES[code]
    for band in bands:
        if band.lower().replace(" ", "") in words:
            return band
    within = [b for b, nm in bands.items() if nm is not None and lo <= nm <= hi]
    return min(within, key=lambda b: abs(bands[b] - (lo + hi) / 2)) if within else None


def by_roles(cube: Cube, name: str, bands: dict[str, float | None]) -> DataFrame:
    """An index of the catalogue over a cube whose bands are told by name or wavelength."""
    used = {x for x in re.findall(r"[a-z]\w*", INDICES[name]) if x in NAMES_OF_ROLES}
    found = {x: next((b for b in (band_of_role(bands, c) for c in NAMES_OF_ROLES[x]) if b), None) for x in used}
    if None in found.values():
        raise ValueError(f"no band for {', '.join(sorted(x for x, b in found.items() if b is None))} of {name}")
    rows = cube.rows.select(*cube.keys, cube.ts, *[F.col(f"`{b}`").alias(x) for x, b in found.items()])
    return evaluate(Cube(rows, cube.keys, cube.ts), INDICES[name], name)


def nearest_bands(wavelengths: dict[str, float], name: str) -> tuple[str, str]:
    """The bands nearest to the pair of a fixed index, each within the index's tolerance; the first named on ties."""
    *centres, tolerance = WAVELENGTHS[name]
    out = []
    for centre in centres:
        band = min(wavelengths, key=lambda b: abs(wavelengths[b] - centre))
        if abs(wavelengths[band] - centre) > tolerance:
            raise ValueError(f"no band within {tolerance} nm of {centre} nm for {name}")
        out.append(band)
    return out[0], out[1]


def by_wavelength(cube: Cube, wavelengths: dict[str, float], name: str) -> DataFrame:
    """A fixed normalised difference of a cube whose bands have these centres in nm."""
    a, b = nearest_bands(wavelengths, name)
    return evaluate(cube, f"nd({a}, {b})", name)


def _kernels(sza: Column, vza: Column, raa: Column) -> tuple[Column, Column]:
    """Ross-Thick and Li-Sparse-Reciprocal kernels of angles in degrees (h/b = 2, b/r = 1)."""
    s, v, a = (F.radians(x) for x in (sza, vza, raa))
    cosp = F.cos(s) * F.cos(v) + F.sin(s) * F.sin(v) * F.cos(a)
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosp)))
    ross = ((F.lit(3.141592653589793 / 2) - p) * cosp + F.sin(p)) / (F.cos(s) + F.cos(v)) - F.lit(3.141592653589793 / 4)
    ts, tv = F.tan(s), F.tan(v)
    d2 = ts * ts + tv * tv - 2 * ts * tv * F.cos(a)
    sec = 1 / F.cos(s) + 1 / F.cos(v)
    cost = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.sqrt(F.greatest(F.lit(0.0), d2 + F.pow(ts * tv * F.sin(a), F.lit(2.0)))) / sec))
    t = F.acos(cost)
    overlap = (t - F.sin(t) * cost) * sec / F.lit(3.141592653589793)
    li = overlap - sec + 0.5 * (1 + cosp) / (F.cos(s) * F.cos(v))
    return ross, li


def nadir_adjusted(rows: DataFrame, bands: list[str], fixed_sza: float | None = None) -> DataFrame:
    """Bands as seen from above at the scene's mean (or a fixed) sun angle: rows have sza, vza, raa in degrees and ts."""
    scene = rows.groupBy("ts").agg(F.avg("sza").alias("sza0"))
    both = rows.join(scene, "ts").withColumn("sza0", F.lit(fixed_sza).cast("double") if fixed_sza is not None else F.col("sza0"))
    ross, li = _kernels(F.col("sza"), F.col("vza"), F.col("raa"))
    ross0, li0 = _kernels(F.col("sza0"), F.lit(0.0), F.lit(0.0))
    out = []
    for b in bands:
        iso, geo, vol = BRDF[b]
        out.append((F.col(b) * (iso + geo * li0 + vol * ross0) / (iso + geo * li + vol * ross)).alias(b))
    return both.select(*[c for c in rows.columns if c not in bands], *out)
