"""Ways to run a build's tasks elsewhere: job files for a batch scheduler, and how many processors there are."""

from __future__ import annotations

import os
import re

from cellgrid.operators.deck import topological


def cpus_of_mask(status: str) -> int | None:
    """Processors that a process may run on, from the mask in its status text."""
    found = re.search(r"(?m)^Cpus_allowed:\s*([0-9a-fA-F,]+)$", status)
    return bin(int(found.group(1).replace(",", ""), 16)).count("1") or None if found else None


def available_cpus(status_path: str = "/proc/self/status") -> int:
    """Processors that this process may run on: by its mask, else all that the system has, at least one."""
    try:
        with open(status_path) as file:
            return cpus_of_mask(file.read()) or os.cpu_count() or 1
    except OSError:
        return os.cpu_count() or 1


def job_files(build, executable: str, folder: str) -> dict[str, str]:
    """Text of each pending task's job file, and of the graph that orders them, by file name.

    A job asks for its subset's processors and memory (in MB), and for graphics processors only if it wants any.
    """
    tasks = build.deck.tasks()
    pending = [t for t in topological(tasks) if not build.is_complete(t)]
    files, graph = {}, []
    for task in pending:
        execution = build.config["execution"] if task == "Pool" else build.settings(task)["execution"]
        lines = ["getenv = true", f"executable = {executable}", f'arguments = "{"pool" if task == "Pool" else f"process {task}"}"']
        lines += [f"{name} = {folder}/{task}.{end}" for name, end in (("log", "log"), ("output", "out"), ("error", "error"))]
        lines += [f"request_cpus = {execution['n_cpus'] or available_cpus()}"]
        lines += [f"request_gpus = {execution['n_gpus']}"] if execution["n_gpus"] else []
        files[f"{task}.condor"] = "\n".join([*lines, f"request_memory = {execution['memory'] * 1024}", "queue 1", ""])
        graph.append(f"JOB {task} {folder}/{task}.condor DIR {build.out}")
    for task in pending:
        parents = [d for d in tasks[task] if d in pending]
        if parents:
            graph.append(f"PARENT {' '.join(parents)} CHILD {task}")
    files["_dag.condor"] = "\n".join([*graph, ""])
    return files
