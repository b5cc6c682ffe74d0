"""The outputs of a run as one ZIP file."""

from __future__ import annotations

import os
from pathlib import Path
from zipfile import ZIP_DEFLATED, ZipFile

# Outputs that are no tracks to play, and their folders; the folder of all others.
FOLDERS = {"source_audio": "debug/audio_preparation", "gated_audio": "debug/context_detector", "events_json": "debug/context_detector"}
OTHERS = "debug/pipeline"


def place(key: str, name: str) -> str:
    """Where an output stands in the archive: WAV files that are tracks to play at the root, all others below debug."""
    if key in FOLDERS:
        return f"{FOLDERS[key]}/{name}"
    return name if name.lower().endswith(".wav") else f"{OTHERS}/{key}/{name}"


def entries(outputs: dict[str, str], video: str, folder: str | None = None) -> dict[str, Path]:
    """Names in the archive and the files behind them: the video, tracks to play, other outputs, then what else the folder
    holds. A file stands once, whatever its keys; outputs that are no files are left out. Two files of one name are an error,
    and so are a missing video and the lack of any track."""
    if not Path(video).is_file():
        raise FileNotFoundError(f"no such video: {video}")
    files = {key: Path(x) for key, x in outputs.items() if Path(x).is_file()}
    placed = [(place(key, x.name), x) for key, x in files.items()]
    tracks = [p for p in placed if "/" not in p[0]]
    if not tracks:
        raise ValueError("no track to play among the outputs")
    rest = [p for p in placed if "/" in p[0]]
    if folder is not None:
        inside = [(x.relative_to(folder).as_posix(), x) for x in sorted(Path(folder).rglob("*")) if x.is_file()]
        rest += [(name if name.startswith("debug/") else f"{OTHERS}/{name}", x) for name, x in inside]
    found: dict[str, Path] = {}
    seen: set[Path] = set()
    for name, x in [(f"video{Path(video).suffix.lower()}", Path(video)), *tracks, *rest]:
        if (real := x.resolve()) in seen:
            continue
        if name in found:
            raise ValueError(f"two files would be {name}: {found[name]} and {x}")
        seen.add(real)
        found[name] = x
    return found


def pack(outputs: dict[str, str], video: str, target: str, folder: str | None = None) -> Path:
    """Writes the archive of `entries` beside its place first and then moves it there, so a broken run leaves no half of one.
    The video goes in as it is."""
    at = Path(target)
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_name(at.name + ".part")
    found = {name: x for name, x in entries(outputs, video, folder).items() if x.resolve() not in (at.resolve(), part.resolve())}
    try:
        with ZipFile(part, "w", compression=ZIP_DEFLATED) as archive:
            for name, x in found.items():
                archive.write(x, name)
        os.replace(part, at)
    finally:
        part.unlink(missing_ok=True)
    return at
