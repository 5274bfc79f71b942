"""Rules on single rows: languages, texts, masks, artifact names, colours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detector codes and their languages.
DETECTED = {"ja": "jpn", "eng": "eng"}
#: Languages whose boxes are read from right to left.
RTL = ("jpn", "chi_sim", "chi_tra", "ara", "fas", "heb")
#: Texts of these alone are symbols (ASCII and full-width marks).
SYMBOLS = r"[～．ー！？０-９~.!?0-9-]*"
#: File endings of artifacts.
SUFFIXES = {
    "base": "_base.png",
    "raw_mask": "_raw_mask.png",
    "mask": "_mask.png",
    "raw_boxes": "_raw_boxes.png",
    "raw_json": "#raw.json",
    "boxes": "_boxes.png",
    "final_boxes": "_boxes_final.png",
    "clean_json": "#clean.json",
    "box_mask": "_box_mask.png",
    "cut_mask": "_cut_mask.png",
    "fitments": "_mask_fitments.png",
    "final_mask": "_combined_mask.png",
    "overlay": "_with_masks.png",
    "deviations": "_std_devs.png",
    "masked": "_clean.png",
    "text": "_text.png",
    "mask_data": "#mask_data.json",
    "noise_mask": "_noise_mask.png",
    "denoised": "_clean_denoised.png",
    "inpaint_mask": "_inpainting.png",
    "inpainted": "_clean_inpaint.png",
}


def map_languages(lang: Column, mode: str = "auto") -> Column:
    """Detected code to language, null if unknown; a fixed language stands for all."""
    if mode not in ("auto", "page"):
        return F.lit(mode)
    out = F.lit(None).cast("string")
    for code, name in DETECTED.items():
        out = F.when(lang == code, F.lit(name)).otherwise(out)
    return out


def keeps_detection(area: Column, lang: Column, min_area: int = 400, suspicious_area: int = 40_000, strict: bool = False) -> Column:
    """Not too small, and of a known language unless large (with ``strict`` always)."""
    large = (area >= min_area) & (lang.isNotNull() | (area >= suspicious_area))
    return large & lang.isNotNull() if strict else large


def is_symbol_only(text: Column, pattern: str = SYMBOLS) -> Column:
    """The pattern matches the whole text, line ends included; null stays null."""
    return text.rlike(rf"(?s)\A(?:{pattern})\z")


def needs_denoise(failed: Column, dev: Column, min_dev: float = 0.25) -> Column:
    return ~failed & (dev > min_dev)


def inpaint_class(failed: Column, dev: Column, thickness: Column, min_dev: float = 15.0, max_thickness: int = 8) -> Column:
    """'failed', 'poor' (deviating, thin enough) or null."""
    poor = (dev >= min_dev) & thickness.isNotNull() & (thickness <= max_thickness)
    return F.when(failed, F.lit("failed")).when(poor, F.lit("poor"))


def inpaint_growth(dev: Column, min_radius: int = 5, max_radius: int = 20, factor: float = 0.2) -> Column:
    return F.least(F.lit(min_radius) + (dev * F.lit(factor)).cast("int"), F.lit(max_radius))


def route_engine(lang: Column, special: Iterable[str] = ("jpn",), general: Iterable[str] = ("eng",), mode: str = "auto") -> Column:
    """'special' for its languages, 'general' for its own, else 'special'; a forced mode where that engine has the language."""
    has_special, has_general = lang.isin(list(special)), lang.isin(list(general))
    both = F.coalesce(has_special, F.lit(False)), F.coalesce(has_general, F.lit(False))
    if mode == "general":
        return F.when(both[1], F.lit("general")).otherwise(F.lit("special"))
    if mode == "special":
        return F.lit("special")
    return F.when(both[0], F.lit("special")).when(both[1], F.lit("general")).otherwise(F.lit("special"))


def clean_ocr_text(text: Column) -> Column:
    """Line ends, tabs and form feeds become one space each; then ends are trimmed."""
    return F.trim(F.translate(text, "\n\r\t\f", "    "))


def badge(value: Column, total: Column | None = None) -> Column:
    """'' for no value or a total of 0, 'v' without a total, else 'v/t'."""
    v = value.cast("string")
    if total is None:
        return F.when(value.isNull() | (value == 0), F.lit("")).otherwise(v)
    none = value.isNull() | (value == 0) | (F.coalesce(total, F.lit(-1)) == 0)
    return F.when(none, F.lit("")).when(total.isNull(), v).otherwise(F.concat(v, F.lit("/"), total.cast("string")))


def artifact_path(folder: Column, uid: Column, stem: Column, output: Column) -> Column:
    suffix = F.lit(None).cast("string")
    for name, ending in SUFFIXES.items():
        suffix = F.when(output == name, F.lit(ending)).otherwise(suffix)
    return F.concat(folder, F.lit("/"), uid, F.lit("_"), stem, suffix)


def id_from_path(path: Column) -> Column:
    """What stands before the first underscore of the file name."""
    return F.split(F.element_at(F.split(path, "/"), -1), "_").getItem(0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def export_path(original: Column, out_dir: str, file_type: str | None = None, mask: bool = False) -> Column:
    """Under an absolute folder, or one beside the original; masks without a type of their own are PNG."""
    name = F.element_at(F.split(original, "/"), -1)
    folder = F.lit(out_dir) if out_dir.startswith("/") else F.concat(parent(original), F.lit(f"/{out_dir}"))
    ending = file_type or (".png" if mask else None)
    return F.concat(folder, F.lit("/"), F.regexp_replace(name, r"\.[^.]+$", ending) if ending else name)


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Integer luminance, rounded down."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def snap_off_white(r: Column, g: Column, b: Column, threshold: int = 240) -> tuple[Column, Column, Column]:
    """Colours whose every channel is above the threshold become white."""
    white = F.least(r, g, b) > threshold
    return tuple(F.when(white, F.lit(255)).otherwise(c) for c in (r, g, b))
