"""Dictionary archives: a zip file of a manifest and dictionary files, one a language."""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path

MANIFEST, FOLDER = "extension.json", "dictionaries"


def write_archive(target: str, manifest: dict, dictionaries: dict[str, str]) -> None:
    """Packs the manifest and the dictionary files (language to the file, or to the folder that Spark wrote it into).

    Files are copied as streams; a folder's part files follow each other in the order of their names. The manifest has
    to list exactly the given languages.
    """
    listed = sorted(d["id"] for d in manifest["dictionaries"])
    if listed != sorted(dictionaries):
        raise ValueError(f"the manifest lists {listed}, not {sorted(dictionaries)}")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, json.dumps(manifest, ensure_ascii=False, indent=2))
        for language, place in sorted(dictionaries.items()):
            parts = sorted(Path(place).glob("part-*")) if Path(place).is_dir() else [Path(place)]
            with z.open(f"{FOLDER}/{language}.fldic", "w", force_zip64=True) as out:
                for p in parts:
                    with p.open("rb") as f:
                        shutil.copyfileobj(f, out)


def unpack_archive(source: str, folder: str) -> dict[str, str]:
    """Unpacks the dictionaries of an archive: language to file."""
    with zipfile.ZipFile(source) as z:
        manifest = json.loads(z.read(MANIFEST))
        return {d["id"]: z.extract(f"{FOLDER}/{d['id']}.fldic", folder) for d in manifest["dictionaries"]}
