"""Scores and MIDI files as tables, and back.

Files are read by Spark as binary rows and parsed on the executors, one file at a time; a file that
cannot be parsed gives one row with an error and never fails the scan.
"""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.shipping import ship_package

#: What names the score in a compressed MusicXML file.
CONTAINER = "META-INF/container.xml"
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

EVENTS = (
    "path string, kind string, part_no int, measure_no int, measure_ord int, seq_no int, offset_q double, offset_in_measure_q double, length_q double,"
    " pitch int, tie string, grace boolean, root_pc int, chord_kind string, degrees array<string>, bass_pc int, ts_num int, ts_den int, bpm double, error string"
)
MIDI_NOTES = "path string, instr int, seq_no int, program int, is_drum boolean, pitch int, velocity int, start_s double, end_s double, bpm double, error string"


def file_parts(paths: DataFrame) -> DataFrame:
    """Theme, model, sample and chunk from a generated file's path; parts that are no numbers are null."""
    number = lambda pattern: F.regexp_extract("path", pattern, 1).try_cast("int")
    return paths.withColumns({
        "theme": F.regexp_extract("path", r"/themes/([^/]+)/", 1),
        "model": F.regexp_extract("path", r"/themes/[^/]+/([^/]+)/sample_", 1),
        "sample_idx": number(r"/sample_(\d+)(?:/|$)"),
        "chunk_idx": number(r"(?:chunk|gen_chunk|raw_chunk)_(\d+)[^/]*$"),
    })


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder whose name matches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


# --- MusicXML -----------------------------------------------------------------------------------


def parse_musicxml(data: bytes) -> Iterator[dict]:
    """Measures, notes, rests and chords in file order; places are in quarters. Compressed files (.mxl) too."""
    root = ET.fromstring(_unpacked(data) if data[:2] == b"PK" else data)
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2]
    for part_no, part in enumerate(root.findall("part")):
        divisions, start, seq, bpm, meter = 1.0, 0.0, 0, None, (4, 4)
        for order, measure in enumerate(part.findall("measure")):
            at, last, furthest = 0.0, 0.0, 0.0
            number = measure.get("number", "")
            base = {"part_no": part_no, "measure_no": int(number) if number.isdigit() else 0, "measure_ord": order}
            events = []
            for e in measure:
                if e.tag == "attributes":
                    divisions = float(e.findtext("divisions", divisions))
                    if (time := e.find("time")) is not None:
                        meter = (int(time.findtext("beats", "4").split("+")[0]), int(time.findtext("beat-type", "4")))
                elif e.tag == "backup":
                    at -= float(e.findtext("duration", "0")) / divisions
                elif e.tag == "forward":
                    at += float(e.findtext("duration", "0")) / divisions
                elif e.tag == "sound" or e.tag == "direction":
                    sound = e if e.tag == "sound" else e.find("sound")
                    if sound is not None and sound.get("tempo"):
                        bpm = float(sound.get("tempo"))
                elif e.tag == "harmony":
                    shift = float(e.findtext("offset", "0")) / divisions
                    events.append({"kind": "chord", "offset_in_measure_q": at + shift} | _chord(e))
                elif e.tag == "note":
                    length = float(e.findtext("duration", "0")) / divisions
                    place = last if e.find("chord") is not None else at
                    ties = {t.get("type") for t in e.findall("tie")}
                    tie = "continue" if len(ties) == 2 else next(iter(ties), None)
                    kind = "rest" if e.find("rest") is not None else "note"
                    events.append({"kind": kind, "offset_in_measure_q": place, "length_q": length, "pitch": _pitch(e), "tie": tie, "grace": e.find("grace") is not None})
                    if e.find("chord") is None:
                        last, at = at, at + length
                furthest = max(furthest, at)
            full = meter[0] * 4 / meter[1]
            for e in [{"kind": "measure", "offset_in_measure_q": 0.0, "length_q": furthest, "ts_num": meter[0], "ts_den": meter[1], "bpm": bpm}, *events]:
                yield base | e | {"seq_no": seq, "offset_q": start + e["offset_in_measure_q"]}
                seq += 1
            start += furthest if order == 0 and 0 < furthest < full else max(furthest, full)


def _unpacked(data: bytes) -> bytes:
    """The score in a compressed MusicXML file: the first root file that its container names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(e for e in ET.fromstring(z.read(CONTAINER)).iter() if e.tag.rpartition("}")[2] == "rootfile")
        return z.read(root.get("full-path"))


def packed_musicxml(text: str) -> bytes:
    """A score as a compressed MusicXML file; equal scores give equal files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        named = '<?xml version="1.0" encoding="UTF-8"?><container><rootfiles><rootfile full-path="score.musicxml"/></rootfiles></container>'
        for name, body in ((CONTAINER, named), ("score.musicxml", text)):
            z.writestr(zipfile.ZipInfo(name), body.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _pitch(note: ET.Element) -> int | None:
    p = note.find("pitch")
    if p is None:
        return None
    return 12 * (int(p.findtext("octave")) + 1) + STEPS[p.findtext("step")] + int(float(p.findtext("alter", "0")))


def _chord(e: ET.Element) -> dict:
    def pc(tag: str) -> int | None:
        found = e.find(tag)
        if found is None:
            return None
        return (STEPS[found.findtext(f"{tag}-step")] + int(float(found.findtext(f"{tag}-alter", "0")))) % 12

    degrees = [f"{d.findtext('degree-type')}:{d.findtext('degree-value')}:{d.findtext('degree-alter', '0')}" for d in e.findall("degree")]
    return {"root_pc": pc("root"), "chord_kind": e.findtext("kind"), "degrees": degrees, "bass_pc": pc("bass")}


def _scan(df: DataFrame, schema: str, parse) -> DataFrame:
    ship_package(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(parse(bytes(content)))
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{"path": path} | r for r in rows], columns=names).astype(object).where(lambda x: x.notna(), None)

    return df.mapInPandas(run, schema)


def read_musicxml(spark: SparkSession, folder: str, pattern: str = "*.musicxml") -> DataFrame:
    """Score events of every file: kind is measure, note, rest or chord; see EVENTS."""
    return _scan(files(spark, folder, pattern), EVENTS, parse_musicxml)


def musicxml(notes: list[dict], chords: list[dict] | None = None, bpm: float = 120.0, divisions: int = 12) -> str:
    """A one-part score in 4/4: notes (offset_q, length_q, pitch) split at barlines with ties, and chords."""
    names = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    score = ET.Element("score-partwise", version="3.1")
    ET.SubElement(ET.SubElement(ET.SubElement(score, "part-list"), "score-part", id="P1"), "part-name").text = "Melody"
    part = ET.SubElement(score, "part", id="P1")
    end = max([n["offset_q"] + n["length_q"] for n in notes], default=4.0)
    sounding: dict[int, list[dict]] = {}
    for n in sorted(notes, key=lambda n: n["offset_q"]):
        for bar in range(int(n["offset_q"] // 4), -int(-(n["offset_q"] + n["length_q"]) // 4)):
            sounding.setdefault(bar, []).append(n)
    held: dict[int, list[dict]] = {}
    for c in chords or []:
        held.setdefault(int(c["offset_q"] // 4), []).append(c)
    for bar in range(max(1, -int(-end // 4))):
        measure = ET.SubElement(part, "measure", number=str(bar + 1))
        if bar == 0:
            attributes = ET.SubElement(measure, "attributes")
            ET.SubElement(attributes, "divisions").text = str(divisions)
            time = ET.SubElement(attributes, "time")
            ET.SubElement(time, "beats").text, ET.SubElement(time, "beat-type").text = "4", "4"
            ET.SubElement(measure, "sound", tempo=str(bpm))
        at = 0.0
        low, high = 4.0 * bar, 4.0 * bar + 4
        for c in held.get(bar, []):
            harmony = ET.SubElement(measure, "harmony")
            root = ET.SubElement(harmony, "root")
            name = names[c["root_pc"]]
            ET.SubElement(root, "root-step").text = name[0]
            if len(name) > 1:
                ET.SubElement(root, "root-alter").text = "1"
            ET.SubElement(harmony, "kind").text = c["kind"]
            ET.SubElement(harmony, "offset").text = str(round((c["offset_q"] - low) * divisions))
        for n in sounding.get(bar, []):
            start, stop = max(n["offset_q"], low), min(n["offset_q"] + n["length_q"], high)
            if start >= stop:
                continue
            if start - low > at:
                rest = ET.SubElement(measure, "note")
                ET.SubElement(rest, "rest")
                ET.SubElement(rest, "duration").text = str(round((start - low - at) * divisions))
            note = ET.SubElement(measure, "note")
            pitch = ET.SubElement(note, "pitch")
            name = names[n["pitch"] % 12]
            ET.SubElement(pitch, "step").text = name[0]
            if len(name) > 1:
                ET.SubElement(pitch, "alter").text = "1"
            ET.SubElement(pitch, "octave").text = str(n["pitch"] // 12 - 1)
            length = round((stop - start) * divisions)
            ET.SubElement(note, "duration").text = str(length)
            if start > n["offset_q"]:
                ET.SubElement(note, "tie", type="stop")
            if stop < n["offset_q"] + n["length_q"]:
                ET.SubElement(note, "tie", type="start")
            if length * 4 % divisions:  # no multiple of a sixteenth: three in the place of two
                changed = ET.SubElement(note, "time-modification")
                ET.SubElement(changed, "actual-notes").text, ET.SubElement(changed, "normal-notes").text = "3", "2"
            at = stop - low
        if at < 4:
            rest = ET.SubElement(measure, "note")
            ET.SubElement(rest, "rest")
            ET.SubElement(rest, "duration").text = str(round((4 - at) * divisions))
    return ET.tostring(score, encoding="unicode")


# --- MIDI ---------------------------------------------------------------------------------------


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def parse_midi(data: bytes) -> Iterator[dict]:
    """Notes in seconds from a standard MIDI file, by track and channel; tempo changes hold for all tracks."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    _, tracks, division = struct.unpack(">HHH", data[8:14])
    if division & 0x8000:
        raise ValueError("SMPTE time is not supported")
    at, tempi, notes = 14, [(0, 500_000)], []
    programs: dict[tuple[int, int], int] = {}
    for track in range(tracks):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, end, tick, status = at + 8, at + 8 + size, 0, 0
        open_notes: dict[tuple[int, int], list[tuple[int, int]]] = {}
        while at < end:
            delta, at = _varlen(data, at)
            tick += delta
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind = data[at]
                length, at = _varlen(data, at + 1)
                if kind == 0x51:
                    tempi.append((tick, int.from_bytes(data[at : at + 3], "big")))
                at += length
            elif status in (0xF0, 0xF7):
                length, at = _varlen(data, at)
                at += length
            else:
                kind, channel = status >> 4, status & 0xF
                first = data[at]
                second = data[at + 1] if kind not in (0xC, 0xD) else 0
                at += 1 if kind in (0xC, 0xD) else 2
                if kind == 0xC:
                    programs[track, channel] = first
                elif kind == 0x9 and second:
                    open_notes.setdefault((channel, first), []).append((tick, second))
                elif kind in (0x8, 0x9):
                    for begun, velocity in open_notes.pop((channel, first), []):
                        notes.append((track, channel, begun, tick, first, velocity))
        at = end
    tempi.sort()
    marks, seconds = [], 0.0
    for k, (tick, tempo) in enumerate(tempi):
        if k:
            seconds += (tick - tempi[k - 1][0]) * tempi[k - 1][1] / division / 1e6
        marks.append((tick, seconds, tempo))

    def when(tick: int) -> float:
        mark = next(m for m in reversed(marks) if m[0] <= tick)
        return mark[1] + (tick - mark[0]) * mark[2] / division / 1e6

    instruments: dict[tuple[int, int], int] = {}
    bpm = 60e6 / ([m for m in tempi if m[0] == 0][-1][1])
    for seq, (track, channel, begun, ended, pitch, velocity) in enumerate(sorted(notes, key=lambda n: (n[0], n[1], n[3], n[2]))):
        instr = instruments.setdefault((track, channel), len(instruments))
        yield {
            "instr": instr, "seq_no": seq, "program": programs.get((track, channel), 0), "is_drum": channel == 9, "pitch": pitch, "velocity": velocity,
            "start_s": when(begun), "end_s": when(ended), "bpm": bpm,
        }


def midi(notes: list[dict], bpm: float = 120.0, division: int = 480) -> bytes:
    """A one-track MIDI file of notes (pitch, velocity, start_s, end_s)."""
    per_second = division * bpm / 60
    events = []
    for n in notes:
        events.append((round(n["start_s"] * per_second), 1, bytes([0x90, n["pitch"], n.get("velocity", 80)])))
        events.append((round(n["end_s"] * per_second), 0, bytes([0x80, n["pitch"], 0])))
    body, last = b"\x00\xff\x51\x03" + round(60e6 / bpm).to_bytes(3, "big"), 0
    for tick, _, event in sorted(events):
        delta, length = tick - last, [(tick - last) & 0x7F]
        while delta := delta >> 7:
            length.append(delta & 0x7F | 0x80)
        body += bytes(reversed(length)) + event
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


def read_midi(spark: SparkSession, folder: str, pattern: str = "*.mid") -> DataFrame:
    """Notes of every MIDI file; see MIDI_NOTES."""
    return _scan(files(spark, folder, pattern), MIDI_NOTES, parse_midi)
