"""python -m tesserae rebuild SLIDE [--out FILE]: a slide's pyramid anew, into a file or in place."""

from __future__ import annotations

import argparse
import tempfile

from tesserae.codecs import raster
from tesserae.operators import slides
from tesserae.session import local


def main() -> None:
    parser = argparse.ArgumentParser(prog="tesserae")
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("rebuild")
    r.add_argument("slide")
    r.add_argument("--out", help="target file; without it the slide is replaced")
    r.add_argument("--workspace", help="folder that executors and the driver share")
    r.add_argument("--compression", choices=("source", "jpeg", "jpeg2000"), default="source")
    r.add_argument("--quality", type=int, default=90)
    r.add_argument("--ratio", type=float, default=20.0)
    r.add_argument("--tile", type=int)
    r.add_argument("--levels", type=int)
    a = parser.parse_args()
    code = raster.JP2K if a.compression == "jpeg2000" else raster.JPEG
    options = {"match_source": a.compression == "source", "encoding": slides.Encoding(code, a.quality, a.ratio), "tile": a.tile, "level_count": a.levels}
    work = a.workspace or f"file://{tempfile.mkdtemp()}"
    spark = local()
    n = slides.rebuild(spark, a.slide, a.out, work, **options) if a.out else slides.rebuild_in_place(spark, a.slide, work, **options)
    print(f"{n} bytes")


if __name__ == "__main__":
    main()
