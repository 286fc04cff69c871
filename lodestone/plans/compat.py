"""Task graphs under the older names: emplace, composed_of, acquire and release on tasks, and an executor that takes such flows."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.plans import graph, runner


class Task:
    """A task of a flow; name, acquire, release, precede and succeed give the task back."""

    def __init__(self, handle: graph.TaskHandle):
        self._handle = handle

    @property
    def id(self) -> int:
        return self._handle.id

    def has_work(self) -> bool:
        return self._handle.has_work

    def name(self, text: str) -> Task:
        self._handle.named(text)
        return self

    def acquire(self, *semaphores: graph.Semaphore) -> Task:
        self._handle.acquire(*semaphores)
        return self

    def release(self, *semaphores: graph.Semaphore) -> Task:
        self._handle.release(*semaphores)
        return self

    def precede(self, *tasks: Task) -> Task:
        self._handle.precede(*(t._handle for t in tasks))
        return self

    def succeed(self, *tasks: Task) -> Task:
        self._handle.succeed(*(t._handle for t in tasks))
        return self


class SubflowTask(Task):
    """A task of the graph that a subflow task builds."""


class _Builds:
    """The calls that add tasks; `kind` is what they return."""

    kind = Task

    def __init__(self, core: graph.Flow):
        self._core = core

    def as_core(self) -> graph.Flow:
        return self._core

    def emplace(self, body: Callable[[], object]) -> Task:
        return self.kind(self._core.spawn(body))

    def emplace_runtime(self, body: Callable[[runner.RuntimeContext], object]) -> Task:
        return self.kind(self._core.spawn_runtime(body))

    def emplace_condition(self, body: Callable[[], int]) -> Task:
        return self.kind(self._core.spawn_condition(body))

    def emplace_multi_condition(self, body: Callable[[], list[int]]) -> Task:
        return self.kind(self._core.spawn_multi_condition(body))

    def emplace_subflow(self, body: Callable[[Subflow], object]) -> Task:
        return self.kind(self._core.spawn_subflow(lambda inner: body(Subflow(inner))))

    def placeholder(self) -> Task:
        return self.kind(self._core.placeholder())


class Subflow(_Builds):
    kind = SubflowTask


class Flow(_Builds):
    def __init__(self, name: str = ""):
        super().__init__(graph.Flow(name))

    def composed_of(self, flow: Flow) -> Task:
        return Task(self._core.compose(flow.as_core()))

    def name(self) -> str:
        return self._core.name

    def set_name(self, text: str) -> None:
        self._core.name = text

    def num_tasks(self) -> int:
        return self._core.num_tasks

    def is_empty(self) -> bool:
        return self.num_tasks() == 0

    def dump_dot(self) -> str:
        return self._core.dump_dot()


class Executor:
    def __init__(self, workers: int = 4, spark=None):
        self._core = runner.Executor(workers, spark)

    def as_core(self) -> runner.Executor:
        return self._core

    def num_workers(self) -> int:
        return self._core.num_workers

    def run(self, flow: Flow) -> runner.RunHandle:
        return self._core.run(flow.as_core())

    def run_n(self, flow: Flow, n: int) -> runner.RunHandle:
        return self._core.run_n(flow.as_core(), n)

    def run_until(self, flow: Flow, predicate: Callable[[], bool]) -> runner.RunHandle:
        return self._core.run_until(flow.as_core(), predicate)

    def wait_for_all(self) -> None:
        self._core.wait_for_all()

    def add_observer(self, observer) -> None:
        self._core.add_observer(observer)

    def async_task(self, body: Callable[[], object]) -> runner.AsyncHandle:
        return self._core.async_task(body)

    def silent_async(self, body: Callable[[], object]) -> runner.RunHandle:
        return self._core.async_task(body)

    def close(self) -> None:
        self._core.close()

    def __enter__(self) -> Executor:
        return self

    def __exit__(self, *_) -> None:
        self.close()
