"""Command line: python -m isochron.cli COMMAND ... ; exit code 2 where an input is missing, 1 where nothing is found."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from isochron.codecs import boxes, calibration, records, sei


def _embedded(args: argparse.Namespace) -> int:
    track = boxes.read_track(args.file.read_bytes())
    print(json.dumps(track.counts() | {"meta": track.meta, "calibration_bytes": len(track.calibration or b"")}))
    files = {"imu": track.imu_bytes(), "vts": track.vts_bytes(), "tel": track.tel_bytes()}
    found = {k: v for k, v in files.items() if v is not None}
    if args.out:
        args.out.mkdir(parents=True, exist_ok=True)
        for kind, content in found.items():
            (args.out / f"{args.file.stem}.{kind}").write_bytes(content)
        if track.meta is not None:
            (args.out / f"{args.file.stem}.json").write_text(json.dumps(track.meta))
        if track.calibration:
            (args.out / f"{args.file.stem}.calib").write_bytes(track.calibration)
    return 0 if found or track.meta or track.calibration else 1


def _stream(args: argparse.Namespace) -> int:
    pts = json.loads(args.pts.read_text()) if args.pts else []
    imu, vts = sei.sidecars(args.file.read_bytes(), pts, args.fps)
    args.out.mkdir(parents=True, exist_ok=True)
    (args.out / f"{args.file.stem}.imu").write_bytes(records.encode_imu(*imu))
    (args.out / f"{args.file.stem}.vts").write_bytes(records.encode_vts(*vts))
    return 0 if len(imu[1]["ts_ns"]) else 1


def _pack(args: argparse.Namespace) -> int:
    args.out.write_bytes(calibration.pack(json.loads(args.file.read_text()), bytes.fromhex(args.chip_id)))
    return 0


def _unpack(args: argparse.Namespace) -> int:
    print(json.dumps(calibration.unpack(args.file.read_bytes()), indent=1))
    return 0


def _inspect(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from isochron.plans import takes

    spark = SparkSession.builder.getOrCreate()
    found = takes.inspected(spark, str(args.file)) if args.file.is_dir() else takes.recording(spark, str(args.file))
    rows = found.toJSON().collect()  # one row a file, or the one recording
    for row in rows:
        print(row)
    return 0 if rows else 1


def _config(args: argparse.Namespace) -> int:
    from isochron.sources import writers

    args.out.mkdir(parents=True, exist_ok=True)
    for name, text in writers.vio_config(calibration.load(args.file.read_bytes()), args.inflation).items():
        (args.out / name).write_text(text)
    return 0


def _trajectory(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from isochron.operators import signal
    from isochron.sources import readers

    poses = readers.long_enough(readers.trajectories(SparkSession.builder.getOrCreate(), str(args.file)))
    for row in signal.trajectory(poses, ["recording_id"], "t_s").toJSON().collect():  # one row a file
        print(row)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="isochron")
    commands = parser.add_subparsers(required=True)
    for name, run, options in (("embedded", _embedded, ["out"]), ("stream", _stream, ["out!", "pts", "fps"]), ("pack", _pack, ["out!", "chip-id"]), ("unpack", _unpack, []), ("inspect", _inspect, []), ("config", _config, ["out!", "inflation"]), ("trajectory", _trajectory, [])):
        sub = commands.add_parser(name)
        sub.add_argument("file", type=Path)
        sub.set_defaults(run=run)
        for option in options:
            kind = {"fps": float, "inflation": float, "chip-id": str}.get(option.rstrip("!"), Path)
            sub.add_argument(f"--{option.rstrip('!')}", type=kind, required=option.endswith("!"), default={"fps": 30.0, "inflation": 5.0, "chip-id": ""}.get(option))
    args = parser.parse_args(argv)
    if not args.file.exists():
        print(f"{args.file} is not there", file=sys.stderr)
        return 2
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
