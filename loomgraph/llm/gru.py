"""A gated recurrent network over symbols with a class-factored softmax, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

F32 = np.float32
#: Symbols of a lane at least when a run of symbols is cut into lanes.
LANE = 1024
#: Numbers between the rows of an array, and logits that are exponentiated without their maximum taken away.
PAD, LARGEST = 16, 60.0
#: Columns of logits in training that are computed at once, so that they stay in the cache.
AT_ONCE = 4096


def _turned_sigmoid(x: np.ndarray) -> np.ndarray:
    """The sigmoid of -x, in place."""
    np.exp(x, out=x)
    x += F32(1)
    return np.reciprocal(x, out=x)


def _padded(*shape: int) -> np.ndarray:
    """An array whose rows don't begin at multiples of a power of two, which would share few places of the cache."""
    return np.empty((shape[0], int(np.prod(shape[1:])) + PAD), F32)[:, :-PAD].reshape(shape)


def _moderate(to: np.ndarray, bias: np.ndarray) -> bool:
    """Whether columns of ``to.T @ h + bias``, h within -1 and 1, can be exponentiated as they are: no sum of theirs
    overflows, and none vanishes."""
    reach = np.abs(to).sum(axis=0)
    return bool((bias + reach).max() < LARGEST and (bias - reach).max() > -LARGEST)


def _softmax(logits: np.ndarray, at: np.ndarray, moderate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of logits: natural log probabilities of the wanted rows, and exponentials with their sums; overwrites
    ``logits``."""
    if not moderate:
        logits -= logits.max(axis=0)
    wanted = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    return wanted - np.log(total), logits, total


def _by_class(classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by class, and where each class begins and ends in it."""
    order = np.argsort(classes, kind="stable")  # of 16-bit integers: by digits
    return order, np.searchsorted(classes[order], np.arange(n + 1))


@dataclass
class Network:
    """``given``: (symbols + 1) x 3h inputs, the last row for the start of a text; ``state``: h x 3h; the output goes to
    classes (h x c) and then to the members of one class (c x h x m, members beyond a class's size masked). Within, states
    are columns: each gate of all lanes is then one stretch of memory."""

    given: np.ndarray
    state: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_member: np.ndarray
    member_bias: np.ndarray
    class_of: np.ndarray
    member_of: np.ndarray
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def fresh(counts: np.ndarray, hidden: int, seed: int = 7) -> "Network":
        """Untrained: whatever the state, the output is the distribution of ``counts``."""
        rng, n = np.random.default_rng(seed), len(counts)
        width = max(1, int(np.ceil(np.sqrt(n))))
        order = np.argsort(-counts, kind="stable")
        class_of, member_of = np.empty(n, np.int64), np.empty(n, np.int64)
        class_of[order], member_of[order] = np.arange(n) // width, np.arange(n) % width
        n_classes = -(-n // width)
        member_bias = np.full((n_classes, width), -1e9, F32)
        member_bias[class_of, member_of] = np.log(counts + 1e-3)
        class_bias = np.log(np.bincount(class_of, weights=counts + 1e-3, minlength=n_classes)).astype(F32)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
        return Network(normal(n + 1, 3 * hidden), normal(hidden, 3 * hidden), np.zeros((hidden, n_classes), F32), class_bias, np.zeros((n_classes, hidden, width), F32), member_bias, class_of, member_of)

    @property
    def hidden(self) -> int:
        return len(self.state)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.given, self.state, self.to_class, self.class_bias, self.to_member, self.member_bias]

    @property
    def start(self) -> int:
        return len(self.given) - 1

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states (rows) after inputs ``x`` in states ``h``."""
        given, back = self._columns()
        return self._step(given[:, x], h.T, back, np.empty((len(back), len(h)), F32), np.empty(h.shape[::-1], F32)).T

    def _columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the inputs and of the state as columns, those of gates negated."""
        given, back = np.ascontiguousarray(self.given.T), np.ascontiguousarray(self.state.T)
        for x in (given, back):
            np.negative(x[: 2 * self.hidden], out=x[: 2 * self.hidden])
        return given, back

    def _step(self, a: np.ndarray, h: np.ndarray, back: np.ndarray, u: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``out``, the states after ``h`` where ``a`` is given, computed in ``u``."""
        n = self.hidden
        np.matmul(back, h, out=u)
        gates, new = _turned_sigmoid(np.add(u[: 2 * n], a[: 2 * n], out=u[: 2 * n])), u[2 * n :]
        new *= gates[n:]
        new += a[2 * n :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:n]
        out += new
        return out

    def log_prob(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of symbols ``y`` in states ``h`` (rows)."""
        return self._log_prob(h.T, y)

    def _log_prob(self, h: np.ndarray, y: np.ndarray, at_once: int = 8192) -> np.ndarray:
        """As ``log_prob``, of the first columns of ``h``."""
        n, classes, members = len(y), self.class_of[y].astype(np.int16), self.member_of[y]
        out, more = np.empty(n), np.empty(n)
        room = np.empty(max(len(self.class_bias), self.member_bias.shape[1]) * min(at_once, n), F32)

        def logs(to: np.ndarray, bias: np.ndarray, h: np.ndarray, at: np.ndarray, moderate: bool) -> np.ndarray:
            logits = np.matmul(to.T, h, out=room[: len(bias) * len(at)].reshape(len(bias), -1))
            logits += bias[:, None]
            return _softmax(logits, at, moderate)[0]

        moderate = _moderate(self.to_class, self.class_bias)
        for a in range(0, n, at_once):
            b = min(a + at_once, n)
            out[a:b] = logs(self.to_class, self.class_bias, h[:, a:b], classes[a:b], moderate)
        order, bounds = _by_class(classes, len(self.class_bias))
        h, members = h.take(order, axis=1), members[order]
        for c in np.flatnonzero(np.diff(bounds)):
            moderate = _moderate(self.to_member[c], self.member_bias[c])
            for a in range(bounds[c], bounds[c + 1], at_once):
                b = min(a + at_once, bounds[c + 1])
                more[a:b] = logs(self.to_member[c], self.member_bias[c], h[:, a:b], members[a:b], moderate)
        out[order] += more
        return out

    def score(self, texts: list[np.ndarray], rows_at_once: int = 1024, buffered: int = 1 << 16) -> np.ndarray:
        """Natural log probability of each symbol sequence; the state is carried through all of it.

        Texts advance side by side, longest first. What is given to a stretch of steps is known before, and looked up
        at once.
        """
        out, order, n = np.zeros(len(texts)), np.argsort([-len(t) for t in texts], kind="stable"), self.hidden
        given, back = self._columns()
        room = min(buffered, sum(map(len, texts))) + min(rows_at_once, len(texts))
        states, inputs, u = _padded(n, room), np.empty(3 * n * room, F32), np.empty(3 * n * min(rows_at_once, len(texts)), F32)
        for begin in range(0, len(order), rows_at_once):
            group = order[begin : begin + rows_at_once]
            lengths = np.array([len(texts[i]) for i in group])
            flat, starts = np.concatenate([texts[i] for i in group]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            ends, h, t = np.cumsum(alive), np.zeros((n, len(group)), F32), 0
            while t < len(alive):
                done = int(ends[t - 1]) if t else 0
                until = min(int(np.searchsorted(ends, done + buffered)) + 1, len(alive))
                own = alive[t:until]
                bounds = np.concatenate([[0], np.cumsum(own)])
                who = np.arange(bounds[-1]) - np.repeat(bounds[:-1], own)
                place = starts[who] + np.repeat(np.arange(t, until), own)
                x = flat[place - 1]
                if t == 0:
                    x[: own[0]] = self.start
                a = np.take(given, x, axis=1, out=inputs[: 3 * n * len(x)].reshape(3 * n, -1), mode="clip")
                bounds = bounds.tolist()
                for i, j in zip(bounds, bounds[1:]):
                    h = self._step(a[:, i:j], h[:, : j - i], back, u[: 3 * n * (j - i)].reshape(3 * n, -1), states[:, i:j])
                out[group] += np.bincount(who, weights=self._log_prob(states, flat[place]), minlength=len(group))
                h, t = h.copy(), until
        return out


def train_through(adam: "Adam", targets: np.ndarray, inputs: np.ndarray, rate: float, streams: int = 1024, window: int = 16) -> float:
    """Truncated backpropagation through time, once through a run of symbols that is cut into equal lanes side by side.

    Windows of ``window`` symbols, the state carried from window to window and cleared where a text begins; the last
    window of a lane may go on into the next. Returns the sum of the symbols' log losses before their updates.
    """
    lanes = max(1, min(streams, len(targets) // LANE))
    width, h, loss = -(-len(targets) // lanes), np.zeros((lanes, adam.net.hidden), F32), 0.0
    starts = np.arange(lanes)[:, None] * width
    for at in range(0, width, window):
        places = (starts + at + np.arange(window)) % len(targets)
        h, mean = adam.update(inputs[places], targets[places], h, rate)
        loss += mean * min(window, width - at) * lanes
    return loss


class _Room:
    """Arrays that every window of a shape is computed in: memory that is asked for anew costs page faults."""

    def __init__(self, net: Network, lanes: int, window: int) -> None:
        n, size, (classes, _, width) = net.hidden, lanes * window, net.to_member.shape
        self.shape = lanes, window
        self.inputs = np.empty((3 * n, len(net.given)), F32)
        self.before, self.outs = _padded(n, window, lanes), _padded(n, window, lanes)
        self.u, self.new = _padded(window * 3 * n, lanes).reshape(window, 3 * n, lanes), _padded(window * n, lanes).reshape(window, n, lanes)
        # what is given to both gates, nothing, and what is given to the new state; then the gradients of the gates, of
        # the new state's part from the state before, and of all of it
        self.d = _padded(4 * n, window, lanes)
        # the states of all places by class, and below them a row of ones, with which the biases are multiplied
        self.sorted_out, self.sorted_d, self.d_out = np.ones((n + 1, size), F32), np.empty((n, size), F32), np.empty((n, size), F32)
        self.logits = np.empty(max(classes, width) * min(AT_ONCE, size), F32)
        self.grads = [np.empty_like(p) for p in net.params]


class Adam:
    """Steps of truncated backpropagation on a network's weights, in place."""

    def __init__(self, net: Network) -> None:
        self.net, self.params, self.updates, self._room = net, net.params, 0, None
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def update(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One window: inputs and targets by lane and place, states before; returns the states after and the mean loss."""
        net, n, (lanes, window) = self.net, self.net.hidden, x.shape
        if self._room is None or self._room.shape != x.shape:
            self._room = _Room(net, lanes, window)
        room = self._room
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T).ravel()
        begins, flat, d, outs = x == net.start, x.ravel().astype(np.int64), room.d, room.outs
        room.inputs[...], to = net._columns()
        rows = d.reshape(4 * n, -1)
        for given, row in zip(room.inputs, (*rows[: 2 * n], *rows[3 * n :])):
            np.take(given, flat, out=row, mode="clip")
        h = h.T
        for t in range(window):
            before, u, gates, new = room.before[:, t], room.u[t], room.u[t, : 2 * n], room.new[t]
            before[...] = h
            if begins[t].any():
                before[:, begins[t]] = 0
            np.matmul(to, before, out=u)
            gates += d[: 2 * n, t]
            _turned_sigmoid(gates)
            np.multiply(gates[n:], u[2 * n :], out=new)
            new += d[3 * n :, t]
            np.tanh(new, out=new)
            h = outs[:, t]
            np.subtract(before, new, out=h)
            h *= gates[:n]
            h += new
        for g in room.grads:
            g.fill(0)
        loss = _output_gradients(net, room, y)
        d_out = room.d_out.reshape(n, window, lanes)
        d_h, rest = np.zeros((n, lanes), F32), np.empty((n, lanes), F32)
        for t in reversed(range(window)):
            before, new = room.before[:, t], room.new[t]
            z, r, d_z, d_r, d_back, d_new = room.u[t, :n], room.u[t, n : 2 * n], d[:n, t], d[n : 2 * n, t], d[2 * n : 3 * n, t], d[3 * n :, t]
            d_h += d_out[:, t]
            np.subtract(F32(1), z, out=rest)
            np.multiply(new, new, out=d_new)
            np.subtract(F32(1), d_new, out=d_new)
            d_new *= rest
            d_new *= d_h
            rest *= z
            rest *= d_h
            np.subtract(before, new, out=d_z)
            d_z *= rest
            np.multiply(d_new, r, out=d_back)
            np.subtract(F32(1), r, out=d_r)
            d_r *= d_back
            d_r *= room.u[t, 2 * n :]
            d_h *= z
            d_h += np.matmul(net.state, d[: 3 * n, t])
            if begins[t].any():
                d_h[:, begins[t]] = 0
        grads, d = room.grads, d.reshape(4 * n, -1)
        grads[1] += (d[: 3 * n] @ room.before.reshape(n, -1).T).T
        for i, row in enumerate((*d[: 2 * n], *d[3 * n :])):
            grads[0][:, i] = np.bincount(flat, weights=row, minlength=len(net.given))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale, self.updates = min(1.0, 5.0 / (norm + 1e-9)), self.updates + 1
        for p, g, m, v in zip(self.params, grads, self.first, self.second):
            g *= F32(scale)
            m += F32(0.1) * (g - m)
            v += F32(0.01) * (g * g - v)
            p -= F32(rate / (1 - 0.9**self.updates)) * m / (np.sqrt(v / F32(1 - 0.99**self.updates)) + F32(1e-6))
        return outs[:, -1].T.copy(), loss


def _output_gradients(net: Network, room: _Room, y: np.ndarray) -> float:
    """Adds the output layer's gradients of the mean log loss to ``room.grads[2:]`` and sets ``room.d_out``, those of the
    states ``room.outs``; returns the loss."""
    n, classes, grads = len(y), net.class_of[y].astype(np.int16), room.grads
    order, bounds = _by_class(classes, len(net.class_bias))
    out, classes, members = room.sorted_out, classes[order], net.member_of[y][order]
    np.take(room.outs.reshape(len(out) - 1, -1), order, axis=1, out=out[:-1], mode="clip")
    d, loss, part = room.sorted_d, 0.0, F32(1 / n)

    def add(to: np.ndarray, bias: np.ndarray, d_to: np.ndarray, d_bias: np.ndarray, a: int, b: int, at: np.ndarray, moderate: bool) -> np.ndarray:
        """Adds the gradients of columns a to b, whose rows ``at`` are wanted; returns the states'."""
        nonlocal loss
        logits = np.matmul(np.vstack([to, bias]).T, out[:, a:b], out=room.logits[: len(bias) * (b - a)].reshape(len(bias), -1))
        logs, p, total = _softmax(logits, at, moderate)
        loss -= float(logs.sum())
        p *= part / total
        p[at, np.arange(b - a)] -= part
        both = out[:, a:b] @ p.T
        d_to += both[:-1]
        d_bias += both[-1]
        return to @ p

    moderate = _moderate(net.to_class, net.class_bias)
    for a in range(0, n, AT_ONCE):
        b = min(a + AT_ONCE, n)
        d[:, a:b] = add(net.to_class, net.class_bias, grads[2], grads[3], a, b, classes[a:b], moderate)
    for c in np.flatnonzero(np.diff(bounds)):
        moderate = _moderate(net.to_member[c], net.member_bias[c])
        for a in range(bounds[c], bounds[c + 1], AT_ONCE):
            b = min(a + AT_ONCE, bounds[c + 1])
            d[:, a:b] += add(net.to_member[c], net.member_bias[c], grads[4][c], grads[5][c], a, b, members[a:b], moderate)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    np.take(d, back, axis=1, out=room.d_out, mode="clip")
    return loss / n
