"""Rules over a recording's metadata as column expressions: each is a struct of what follows and of the reason why nothing does.

A null input is a field that the recording does not state. `error` is null where the
rule holds; then the other fields say what it gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of recorded fields.
PLANE, DUAL_FISHEYE, FISHEYE, WIDE, HALF_FISHEYE, EQUIRECTANGULAR = 1, 2, 3, 4, 5, 6
UPRIGHT = 1
ONE_STREAM, TWO_FILES, TWO_TRACKS, TWO_TRACKS_REVERSED = 1, 2, 3, 4
SPLIT_FILE, MULTI_TRACK = 1, 2
STANDARD, LOG, DOLBY = 1, 2, 3
#: Optics by recorded state, and by detected guard where the state (6) leaves it to that.
STATES = {0: "bare", 1: "sphere_guard", 2: "case_water", 3: "clear_case_water", 4: "plastic_guard", 5: "glass_guard", 7: "nd16", 8: "nd32", 9: "nd64", 10: "pro_case_water", 11: "pro_case_air", 12: "nd128"}
GUARDS = {1: "plastic_guard", 2: "glass_guard", 3: "bare", 4: "mean_guard", 5: "nd16", 6: "nd32", 7: "nd64", 8: "nd128"}
DETECTED = 6
#: Fields that tell of timing; one of them among the unknown fields is malformed.
TIMING_FIELDS = (24, 25, 28, 29, 30, 59, 62, 64, 65, 133)
#: Transfer characteristics of high dynamic range.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")


def ruled(breaches: Sequence[tuple[Column, str]], **values: Column) -> Column:
    """The values, null where a breach holds, and the name of the first that does."""
    error = F
    for condition, name in breaches:
        error = error.when(F.coalesce(condition, F.lit(False)), name)
    error = error.otherwise(None) if breaches else F.lit(None).cast("string")
    return F.struct(*[F.when(error.isNull(), v).alias(k) for k, v in values.items()], error.alias("error"))


def stated(c: Column, *codes: int) -> Column:
    """Whether a field is stated and one of the codes."""
    return F.coalesce(c.isin(*codes), F.lit(False))


def pair_name(path: Column) -> Column:
    """(kind, identity) of a file of a pair: names that differ in _00_ and _10_ alone, in either case of letters; nulls for others."""
    name = F.upper(F.element_at(F.split(path, "/"), -1))
    kind = F.when(F.contains(name, F.lit("_00_")), "primary").when(F.contains(name, F.lit("_10_")), "secondary")
    mark = F.when(kind == "primary", "_00_").otherwise("_10_")
    at = F.locate("_00_", name)
    at = F.when(at > 0, at).otherwise(F.locate("_10_", name))
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.concat(F.substring(name, F.lit(1), at - 1), F.lit("_XX_"), F.substring(name, at + F.length(mark), F.length(name)))).alias("identity"))


def declared_tracks(stream: Column, track_order: Column) -> Column:
    """(tracks, reversed) that a recording declares: the order of tracks by its own field, else by the kind of stream."""
    tracks = F.when(stated(stream, ONE_STREAM, TWO_FILES), 1).when(stated(stream, TWO_TRACKS, TWO_TRACKS_REVERSED), 2)
    turned = F.when(stated(track_order, 1), True).when(stated(track_order, 2), False).when(stated(stream, TWO_TRACKS_REVERSED), True).when(stated(stream, TWO_TRACKS), False)
    return F.struct(tracks.alias("tracks"), turned.alias("reversed"))


def layout(files: Column, tracks: Column, category: Column, rotation: Column, stream: Column, record: Column, turned: Column, packed: Column) -> Column:
    """(layout, first_track): where the first lens is found; packed: whether one track is proven to hold both lenses."""
    dual, pair, single = (files == 1) & (tracks == 2), (files == 2) & (tracks == 1), (files == 1) & (tracks == 1)
    other = lambda c, most: F.coalesce((c < 0) | (c > most), F.lit(False))
    breaches = [
        (F.coalesce(rotation != UPRIGHT, F.lit(False)), "rotated"),
        (stated(category, PLANE, WIDE, HALF_FISHEYE, EQUIRECTANGULAR) | other(category, EQUIRECTANGULAR) | other(record, MULTI_TRACK), "projection"),
        (dual & (stated(stream, ONE_STREAM, TWO_FILES) | other(stream, TWO_TRACKS_REVERSED) | stated(record, SPLIT_FILE)), "contradicts_tracks"),
        (dual & turned.isNull(), "order_undeclared"),
        (pair & (stated(stream, ONE_STREAM, TWO_TRACKS, TWO_TRACKS_REVERSED) | other(stream, TWO_TRACKS_REVERSED) | stated(record, MULTI_TRACK)), "contradicts_pair"),
        (single & ~F.coalesce(packed, F.lit(False)), "not_packed"),
        (~(dual | pair | single), "no_pair"),
    ]
    return ruled(breaches, layout=F.when(dual, "dual_track").when(pair, "two_file").otherwise("packed"), first_track=F.when(dual, turned.cast("int")).otherwise(0))


def packed_proof(name: Column, category: Column, rotation: Column, stream: Column, record: Column, width: Column, height: Column, canvas: Column, centres: Column, prefix: str = "VID_") -> Column:
    """Whether one track holds both lenses side by side: an upright canvas of 2 to 1, and each calibrated centre in its own half.

    canvas: struct (w, h); centres: array of structs (x, y), the first lens first.
    """
    whole = stated(category, DUAL_FISHEYE) & stated(stream, ONE_STREAM) & stated(rotation, UPRIGHT) & ~stated(record, SPLIT_FILE, MULTI_TRACK) & F.startswith(name, F.lit(prefix))
    size = (width > 0) & (height > 0) & (width % 4 == 0) & (height % 2 == 0) & (width == 2 * height)
    half = canvas["w"] / 2
    inside = F.forall(F.transform(centres, lambda c, i: (c["x"] >= half * i) & (c["x"] < half * (i + 1)) & (c["y"] >= 0) & (c["y"] < canvas["h"])), lambda ok: ok)
    return F.coalesce(whole & size & (canvas["w"] == 2 * canvas["h"]) & (F.size(centres) == 2) & inside, F.lit(False))


def colour_conversion(requested: Column, gamma: Column, mode: Column, invalid: Column, has_lut: Column) -> Column:
    """(convert) of a requested conversion (preserve, auto, log): whether the log look-up applies.

    An explicit mode outweighs the gamma label; an unknown or absent one leaves it to
    the label. has_lut: whether the camera has a look-up of its own.
    """
    label, plain = F.coalesce(gamma == "I_Log", F.lit(False)), stated(mode, STANDARD, DOLBY)
    is_log = F.when(stated(mode, LOG), True).when(mode.isNull() | (mode == 0), label).otherwise(False)
    keep, auto, force = requested == "preserve", requested == "auto", requested == "log"
    convert = ~keep & (force | is_log)
    return ruled([(~keep & invalid, "malformed"), (auto & label & plain, "conflict"), (force & plain, "not_log"), (convert & ~F.coalesce(has_lut, F.lit(False)), "no_lut")], convert=convert)


def standard_range(mode: Column) -> Column:
    """Whether a recorded colour mode is of standard dynamic range, as panoramas need."""
    return ~stated(mode, DOLBY)


def standard_transfer(transfer: Column) -> Column:
    return ~F.coalesce(transfer.isin(*HDR_TRANSFERS), F.lit(False))


def colour_check(requested: Column, gamma: Column, mode: Column, invalid: Column, has_lut: Column, needs_standard: Column) -> Column:
    """The conversion rule, and beside it standard range where that is needed or a look-up applies."""
    found = colour_conversion(requested, gamma, mode, invalid, has_lut)
    return F.coalesce(found["error"], F.when((needs_standard | found["convert"]) & ~standard_range(mode), "high_range"))


def underwater_options(mode: Column, strength: Column, balance: Column, style: Column) -> Column:
    """The first rule that the options of a restoration mode (off, legacy, ai) break; null where they are fine."""
    share = lambda c: c.isNotNull() & (F.isnan(c) | (c < 0) | (c > 1))
    some = strength.isNotNull() | balance.isNotNull() | style.isNotNull()
    return ruled([(share(strength), "strength"), (share(balance), "balance"), ((mode == "off") & some, "needs_mode"), ((mode == "legacy") & style.isNotNull(), "style_needs_ai"), ((mode == "ai") & balance.isNotNull(), "balance_needs_legacy"), ((mode == "ai") & ((style < 0) | (style > 3)), "style")])["error"]


def projection_size(width: Column, height: Column) -> Column:
    """Whether a panorama's size is 2 to 1 and not empty."""
    return F.coalesce((width > 0) & (height > 0) & (width == 2 * height), F.lit(False))


def export_options(quality: Column, exists: Column, width: Column, height: Column) -> Column:
    """The first rule that a video export breaks; a null size is the source's own."""
    sized = width.isNotNull() | height.isNotNull()
    return ruled([(~quality.between(1, 100), "quality"), (exists, "exists"), (sized & ~projection_size(width, height), "size"), (sized & ((width % 2 != 0) | (height % 2 != 0)), "odd_size")])["error"]


def capture_start(raw_clock: Column, timelapse_s: Column, timelapse_ms: Column, first: Column) -> Column:
    """Microseconds of the capture clock at the first frame; null for other clocks, time lapses and negative times."""
    lapse = F.coalesce(timelapse_s > 0, F.lit(False)) | F.coalesce(timelapse_ms > 0, F.lit(False))
    return F.when(F.coalesce(raw_clock, F.lit(False)) & ~lapse & (first >= 0), first)


def gyro_adjustment(flag: Column, ms: Column) -> Column:
    """(us) by which motion clocks are moved: as stated with its flag, none where the flag is off."""
    value = F.when(flag, ms).otherwise(F.lit(0.0)) * 1000
    return ruled([(flag & ms.isNull(), "missing"), (flag.isNull() & ms.isNotNull() & ((ms != 0) | F.isnan(ms)), "no_flag"), (F.isnan(value) | (F.abs(value) > float(2**63)), "range")], us=value)


def timing(unknown: Column, timelapse_s: Column, timelapse_ms: Column, readout_ms: Column) -> Column:
    """The first reason why a recording's clocks cannot be followed; unknown: numbers of the fields left undecoded."""
    odd = F.arrays_overlap(unknown, F.array(*map(F.lit, TIMING_FIELDS)))
    return ruled([(odd, "malformed"), ((timelapse_s != 0) | (timelapse_ms != 0), "time_lapse"), (F.isnan(readout_ms) | (readout_ms < 0) | (readout_ms == float("inf")), "readout")])["error"]


def recorded_optics(requested: Column, state: Column, guard: Column, auto: str = "auto") -> Column:
    """(optics): an explicit request, else the recorded state, else the detected guard; auto where no state is recorded."""
    table = lambda c, names: F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), c)
    found = F.when(state == DETECTED, table(guard, GUARDS)).otherwise(table(state, STATES))
    asked = requested != auto
    breaches = [(~asked & (state == DETECTED) & (guard.isNull() | (guard == 0)), "not_detected"), (~asked & state.isNotNull() & found.isNull(), "unknown_code")]
    return ruled(breaches, optics=F.when(asked, requested).when(state.isNull(), F.lit(auto)).otherwise(found))


def readout(rotation: Column, unknown: Column, crop: Column, ms: Column) -> Column:
    """(seconds) of the sweep over the rows, from the top; crop: struct (sw, sh, dw, dh, x, y), which must lie in the sensor.

    Offsets move the crop from the sensor's centre.
    """
    def outside(source: str, inner: str, offset: str) -> Column:
        start = (crop[source] - crop[inner]) / 2 + crop[offset]
        return (start < 0) | (start + crop[inner] > crop[source])

    size = lambda a, b: (crop[a] <= 0) | (crop[b] <= 0) | (crop[b] > crop[a])
    breaches = [
        (~stated(rotation, UPRIGHT) | F.arrays_overlap(unknown, F.array(F.lit(27), F.lit(130))), "ambiguous"),
        (crop.isNull(), "no_crop"),
        (size("sw", "dw") | size("sh", "dh"), "crop_size"),
        (outside("sw", "dw", "x") | outside("sh", "dh", "y"), "crop_outside"),
        (ms.isNull(), "no_time"),
        (F.isnan(ms) | (ms < 0) | (ms == float("inf")), "time"),
    ]
    return ruled(breaches, seconds=ms / 1000)


def crop_window(fields: Column) -> Column:
    """A crop out of decoded fields, array of structs (number, value): the last of each number counts; null without all four sizes above zero."""
    last = lambda n: F.element_at(F.filter(fields, lambda f: f["number"] == n), -1)["value"]
    some = lambda n: F.size(F.filter(fields, lambda f: f["number"] == n)) > 0
    narrow = lambda v: F.when(v % (1 << 32) >= 1 << 31, v % (1 << 32) - (1 << 32)).otherwise(v % (1 << 32))
    size = {k: F.when(some(n), last(n)) for n, k in enumerate(("sw", "sh", "dw", "dh"), 1)}
    fine = F.lit(True)
    for c in size.values():
        fine = fine & F.coalesce((c > 0) & (c < 1 << 32), F.lit(False))
    shift = {k: F.when(some(n), narrow(last(n))).otherwise(0) for n, k in ((5, "x"), (6, "y"))}
    return F.when(fine, F.struct(*[c.alias(k) for k, c in (size | shift).items()]))


def imu_range(acceleration: Column, turn: Column) -> Column:
    """Both ranges, or null where one is missing or not above zero."""
    fine = lambda c: F.coalesce((c > 0) & (c < float("inf")), F.lit(False))
    return F.when(fine(acceleration) & fine(turn), F.struct(acceleration.cast("double").alias("acc_g"), turn.cast("double").alias("gyro_dps")))


def plane_fits(stride: Column, size: Column, width: Column, height: Column) -> Column:
    """Whether a plane of a picture holds all its rows; the last row may end early."""
    return F.coalesce((width > 0) & (height > 0) & (stride >= width) & (stride * (height - 1) + width <= size), F.lit(False))


def generation_accepted(version: Column, accepted: Column) -> Column:
    """Whether a camera takes calibrations of a version; one that is not known takes all."""
    return accepted.isNull() | F.coalesce(F.array_contains(accepted, version), F.lit(False))


def camera_key(name: Column) -> Column:
    """A camera's name as aliases are compared: letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
