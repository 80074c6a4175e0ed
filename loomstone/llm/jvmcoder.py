"""rangecoder's encode and decode as column functions that run in Spark's JVMs.

One lane after another in compiled code costs far less than all lanes side by side in numpy. The bytes are those of
rangecoder, whose constants the source takes. The source is compiled on the driver by Janino, the compiler that Spark
itself uses for its plans, and the class goes to the executors as a jar, by Spark's own means.
"""

from __future__ import annotations

import atexit
import os
import shutil
import string
import tempfile
import threading
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import rangecoder as r

PACKAGE = "loomstone.llm"
SOURCE = string.Template("""
package loomstone.llm;

/** One block's model and coder; see rangecoder.py, whose names these are. */
public class IdCoder {
    static final int SYMBOLS = $SYMBOLS, CLASSES = $CLASSES, TOTAL = $TOTAL, WEIGHT = $WEIGHT, TABLE = $TABLE, KEPT = $KEPT;
    static final int FLOOR = $FLOOR, LEAST = $LEAST, MOST = (1 << WEIGHT) - 2 * LEAST;
    static final int HEAD = 16, LINE = 12, PLACES = 4 * KEPT;
    static final byte[] MAGIC = {$MAGIC};

    // orders 2 and 1, their distributions (8 numbers a row, of which SYMBOLS + 1 are bounds) and weights
    final int[] seen2 = new int[TABLE], seen1 = new int[TABLE], older = new int[TABLE];
    final int[] by2 = new int[512], by1 = new int[512], by0 = new int[512];
    final int[] classes = new int[CLASSES + 1], bounds = new int[8];
    int w2, w1, history, last1, last2;
    // order 0, and where the encoder finds an id in it: id + 1 (0: none) and place
    final int[] ids = new int[KEPT], weights = new int[KEPT], sums = new int[KEPT + 1];
    final int[] keys = new int[PLACES], places = new int[PLACES];
    int kept, summed;
    // what predict() found
    int at2, at1, row2, row1, row0, guess2, guess1, guess0, sure2, sure1;
    // bounds of the range, the code read so far, and the 16-bit words as bytes
    long low, range, code;
    boolean decoding;
    byte[] words;
    int at, end;

    void reset() {
        java.util.Arrays.fill(seen2, 0);
        java.util.Arrays.fill(seen1, 0);
        java.util.Arrays.fill(older, 0);
        java.util.Arrays.fill(keys, 0);
        for (int row = 0; row < 512; row += 8) {
            for (int k = 0; k <= SYMBOLS; k++) {
                int even = (k << TOTAL) / SYMBOLS;
                by2[row + k] = even;
                by1[row + k] = even;
                by0[row + k] = even;
            }
        }
        for (int k = 0; k <= CLASSES; k++) classes[k] = (k << TOTAL) / CLASSES;
        w2 = w1 = (1 << WEIGHT) / 3;
        history = $NEW * 9;
        last1 = last2 = kept = summed = 0;
        low = 0L;
        range = -1L;
    }

    static boolean due(int step) {
        return step % $EVERY == 0 || step < 4 * $EVERY && step % 8 == 0;
    }

    void sumUp() {
        int sum = 0, n = kept;
        for (int k = 0; k < n; k++) {
            sum += weights[k];
            sums[k + 1] = sum;
        }
        summed = n;
    }

    void predict() {
        at1 = (int) ((last1 * 0x9E3779B1L) >> 7) & (TABLE - 1);
        at2 = (int) ((last1 * 0x2C1B3C6DL + last2 * 0x9E3779B1L) >> 9) & (TABLE - 1);
        int s2 = seen2[at2], s1 = seen1[at1];
        guess2 = s2 >> 3;
        guess1 = s1 >> 3;
        guess0 = older[at1];
        sure2 = s2 & 7;
        sure1 = s1 & 7;
        row2 = (sure2 << 3 | (guess2 == guess1 ? 4 : 0) | sure1 >> 1) << 3;
        row1 = (sure1 << 3 | history & 7) << 3;
        row0 = history << 3;
        int a = w2, b = w1;
        for (int k = 0; k <= SYMBOLS; k++) {
            int own0 = by0[row0 + k];
            bounds[k] = own0 + (((by2[row2 + k] - own0) * a + (by1[row1 + k] - own0) * b) >> WEIGHT);
        }
    }

    static void follow(int[] table, int row, int symbol) {
        for (int k = 0; k <= SYMBOLS; k++) {
            int own = table[row + k];
            int aim = k <= symbol ? k * FLOOR : (1 << TOTAL) - (SYMBOLS - k) * FLOOR;
            table[row + k] = own + ((aim - own) >> $SLOW);
        }
    }

    void update(int id, int symbol) {
        int share2 = by2[row2 + symbol + 1] - by2[row2 + symbol], share1 = by1[row1 + symbol + 1] - by1[row1 + symbol];
        int share0 = by0[row0 + symbol + 1] - by0[row0 + symbol];
        int part2 = w2 * (share2 >> 2), part1 = w1 * (share1 >> 2);
        int whole = Math.max((part2 + part1 + ((1 << WEIGHT) - w2 - w1) * (share0 >> 2) + 1) >> WEIGHT, 1);
        int new2 = w2 + ((Math.min(part2 / whole, 1 << WEIGHT) - w2) >> $SLOW_WEIGHT);
        int new1 = w1 + ((Math.min(part1 / whole, 1 << WEIGHT) - w1) >> $SLOW_WEIGHT);
        new2 = Math.min(Math.max(new2, LEAST), MOST);
        new1 = Math.min(Math.max(new1, LEAST), MOST);
        int over = Math.max(new2 + new1 - ((1 << WEIGHT) - LEAST), 0);
        if (new2 >= new1) new2 -= over;
        else new1 -= over;
        w2 = new2;
        w1 = new1;
        follow(by2, row2, symbol);
        follow(by1, row1, symbol);
        follow(by0, row0, symbol);
        int known = id << 3;
        seen2[at2] = guess2 == id ? known | Math.min(sure2 + 1, 7) : sure2 > 1 ? guess2 << 3 | sure2 >> 1 : known;
        if (guess1 == id) {
            seen1[at1] = known | Math.min(sure1 + 1, 7);
        } else {
            seen1[at1] = known;
            older[at1] = guess1;
        }
        history = (history << 3 | symbol) & 63;
        last2 = last1;
        last1 = id;
    }

    void add(int id) {
        if (kept < KEPT) {
            ids[kept] = id;
            weights[kept++] = $FIRST;
        }
    }

    void learnClass(int kind) {
        for (int k = 0; k <= CLASSES; k++) {
            int aim = k <= kind ? k * FLOOR : (1 << TOTAL) - (CLASSES - k) * FLOOR;
            classes[k] += (aim - classes[k]) >> $SLOW_CLASS;
        }
    }

    /** The slot of an id, or the free one where it would be. */
    int slot(int id) {
        int k = (id * 0x9E3779B1) >>> 8 & (PLACES - 1);
        while (keys[k] != 0 && keys[k] != id + 1) k = (k + 1) & (PLACES - 1);
        return k;
    }

    void put() {
        words[at++] = (byte) (low >>> 48);
        words[at++] = (byte) (low >>> 56);
    }

    int next() {
        if (at >= end) return 0;
        int word = words[at] & 255 | (words[at + 1] & 255) << 8;
        at += 2;
        return word;
    }

    void narrow(long begin, long size, long step) {
        low += begin * step;
        range = size * step;
        while (true) {
            boolean same = (low ^ (low + range)) >>> 48 == 0;
            if (!same) {
                if (range >>> 32 != 0) return;
                range = -low & 0xFFFFFFFFL;
            }
            if (decoding) code = code << 16 | next();
            else put();
            low <<= 16;
            range <<= 16;
        }
    }

    /** Whether the code lies at or above the begin-th step. */
    boolean reaches(long begin, long step) {
        return begin * step + Long.MIN_VALUE <= code - low + Long.MIN_VALUE;
    }

    void rawOut(int bits, int value) {
        for (int shift = 15; shift >= 0; shift -= 15) {
            if (bits > shift) {
                int size = Math.min(bits - shift, 15);
                narrow(value >> shift & (1 << size) - 1, 1L, range >>> size);
            }
        }
    }

    int rawIn(int bits) {
        int out = 0;
        for (int shift = 15; shift >= 0; shift -= 15) {
            if (bits > shift) {
                int size = Math.min(bits - shift, 15);
                long step = range >>> size;
                long part = Math.min(Long.divideUnsigned(code - low, step), (1L << size) - 1);
                narrow(part, 1L, step);
                out |= (int) part << shift;
            }
        }
        return out;
    }

    static int number(byte[] from, int at) {
        return from[at] & 255 | (from[at + 1] & 255) << 8 | (from[at + 2] & 255) << 16 | (from[at + 3] & 255) << 24;
    }

    static void number(byte[] to, int at, int value) {
        to[at] = (byte) value;
        to[at + 1] = (byte) (value >> 8);
        to[at + 2] = (byte) (value >> 16);
        to[at + 3] = (byte) (value >> 24);
    }

    static int crc(byte[] of, int from, int size) {
        java.util.zip.CRC32 crc = new java.util.zip.CRC32();
        crc.update(of, from, size);
        return (int) crc.getValue();
    }

    void encodeBlock(byte[] raw, int from, int n) {
        reset();
        for (int t = 0; t < n; t++) {
            if (due(t)) sumUp();
            int id = number(raw, from + 4 * t);
            if (id >>> 28 != 0) throw new IllegalArgumentException("ids must be from 0 to 2 ** 28 - 1");
            predict();
            int symbol, where = KEPT, slot = 0;
            if (guess2 == id) symbol = $HIT2;
            else if (guess1 == id) symbol = $HIT1;
            else if (guess0 == id) symbol = $OLDER;
            else {
                slot = slot(id);
                if (keys[slot] != 0) where = places[slot];
                symbol = where < summed ? $KNOWN : $NEW;
            }
            int first = bounds[symbol];
            narrow(first, bounds[symbol + 1] - first, range >>> TOTAL);
            if (symbol == $KNOWN) {
                first = sums[where];
                narrow(first, sums[where + 1] - first, Long.divideUnsigned(range, sums[summed]));
                weights[where] += $AGAIN;
            } else if (symbol == $NEW) {
                int kind = Math.max(31 - Integer.numberOfLeadingZeros(id), 0), bits = Math.max(kind, 1);
                first = classes[kind];
                narrow(first, classes[kind + 1] - first, range >>> TOTAL);
                rawOut(bits, id & (1 << bits) - 1);
                learnClass(kind);
                if (keys[slot] == 0 && kept < KEPT) {
                    keys[slot] = id + 1;
                    places[slot] = kept;
                }
                add(id);
            }
            update(id, symbol);
        }
        for (int k = 0; k < 4; k++) {
            put();
            low <<= 16;
        }
    }

    void decodeBlock(byte[] raw, int to, int n) {
        reset();
        code = 0L;
        for (int k = 0; k < 4; k++) code = code << 16 | next();
        for (int t = 0; t < n; t++) {
            if (due(t)) sumUp();
            predict();
            long step = range >>> TOTAL;
            int symbol = 0, id;
            while (symbol < SYMBOLS - 1 && reaches(bounds[symbol + 1], step)) symbol++;
            int first = bounds[symbol];
            narrow(first, bounds[symbol + 1] - first, step);
            if (symbol == $KNOWN) {
                step = Long.divideUnsigned(range, sums[summed]);
                int where = 0, left = summed;
                long reach = code - low + Long.MIN_VALUE;
                while (left > 1) { // the last place whose sum isn't above the code
                    int half = left >>> 1, middle = where + half;
                    where = sums[middle] * step + Long.MIN_VALUE <= reach ? middle : where;
                    left -= half;
                }
                first = sums[where];
                narrow(first, sums[where + 1] - first, step);
                weights[where] += $AGAIN;
                id = ids[where];
            } else if (symbol == $NEW) {
                step = range >>> TOTAL;
                int kind = 0;
                while (kind < CLASSES - 1 && reaches(classes[kind + 1], step)) kind++;
                first = classes[kind];
                narrow(first, classes[kind + 1] - first, step);
                id = rawIn(Math.max(kind, 1));
                if (kind > 0) id |= 1 << kind;
                learnClass(kind);
                add(id);
            } else {
                id = symbol == $HIT2 ? guess2 : symbol == $HIT1 ? guess1 : guess0;
            }
            number(raw, to + 4 * t, id);
            update(id, symbol);
        }
    }

    /** A chunk of ids, given as little-endian 32-bit numbers. */
    public static byte[] encode(byte[] raw) {
        int count = raw.length / 4, block = $BLOCK, n = (count + block - 1) / block, size = HEAD + n * LINE;
        IdCoder coder = new IdCoder();
        byte[][] bodies = new byte[n][];
        byte[] heads = new byte[size], words = new byte[8 * Math.min(count, block) + 16];
        System.arraycopy(MAGIC, 0, heads, 0, 8);
        number(heads, 8, n);
        number(heads, 12, block);
        for (int k = 0; k < n; k++) {
            int own = Math.min(block, count - k * block);
            coder.words = words;
            coder.at = 0;
            coder.encodeBlock(raw, 4 * k * block, own);
            bodies[k] = java.util.Arrays.copyOf(words, coder.at);
            number(heads, HEAD + k * LINE, own);
            number(heads, HEAD + k * LINE + 4, coder.at / 2);
            number(heads, HEAD + k * LINE + 8, crc(raw, 4 * k * block, 4 * own));
            size += coder.at;
        }
        byte[] out = java.util.Arrays.copyOf(heads, size);
        int at = heads.length;
        for (int k = 0; k < n; k++) {
            System.arraycopy(bodies[k], 0, out, at, bodies[k].length);
            at += bodies[k].length;
        }
        return out;
    }

    /** The ids of a chunk as little-endian 32-bit numbers. */
    public static byte[] decode(byte[] data) {
        for (int k = 0; k < 8; k++) if (data.length < HEAD || data[k] != MAGIC[k]) throw new IllegalArgumentException("these aren't coded ids");
        int n = number(data, 8), count = 0, at = HEAD + n * LINE;
        for (int k = 0; k < n; k++) count += number(data, HEAD + k * LINE);
        byte[] raw = new byte[4 * count];
        IdCoder coder = new IdCoder();
        coder.decoding = true;
        coder.words = data;
        int to = 0;
        for (int k = 0; k < n; k++) {
            int own = number(data, HEAD + k * LINE);
            coder.at = at;
            at += 2 * number(data, HEAD + k * LINE + 4);
            coder.end = at;
            boolean whole = false;
            try {
                coder.decodeBlock(raw, to, own);
                whole = crc(raw, to, 4 * own) == number(data, HEAD + k * LINE + 8);
            } catch (ArithmeticException e) {
                whole = false;
            } catch (IndexOutOfBoundsException e) {
                whole = false;
            }
            if (!whole) throw new IllegalArgumentException("block " + k + " is damaged");
            to += 4 * own;
        }
        return raw;
    }

    public static class Encode implements org.apache.spark.sql.api.java.UDF1 {
        public Object call(Object raw) {
            return raw == null ? null : IdCoder.encode((byte[]) raw);
        }
    }

    public static class Decode implements org.apache.spark.sql.api.java.UDF1 {
        public Object call(Object data) {
            return data == null ? null : IdCoder.decode((byte[]) data);
        }
    }
}
""")

_lock = threading.Lock()
_made: tuple | None = None  # the SparkContext, its classes' loader


def source() -> str:
    names = "SYMBOLS CLASSES TOTAL WEIGHT TABLE KEPT FLOOR LEAST SLOW SLOW_CLASS SLOW_WEIGHT EVERY FIRST AGAIN BLOCK HIT2 HIT1 OLDER KNOWN NEW"
    return SOURCE.substitute({x: getattr(r, x) for x in names.split()}, MAGIC=", ".join(map(str, r.MAGIC)))


def _loader(spark: SparkSession):
    """The loader of the compiled classes; the executors get them as a jar, once a context."""
    global _made
    with _lock:
        context = spark.sparkContext
        if _made is None or _made[0] is not context:
            compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(context._jsc.getClass().getClassLoader())
            compiler.cook(source())
            folder = os.path.realpath(tempfile.mkdtemp(prefix="loomstone-jar-"))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that start later fetch it, too
            path = os.path.join(folder, f"{os.path.basename(folder)}.jar")
            with zipfile.ZipFile(path, "w") as jar:
                for name, code in compiler.getBytecodes().items():
                    jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
            context._jsc.addJar(path)
            _made = context, compiler.getClassLoader()
        return _made[1]


def _called(spark: SparkSession, name: str, column: Column) -> Column:
    made = _loader(spark).loadClass(f"{PACKAGE}.IdCoder${name}").getDeclaredConstructor(None).newInstance(None)
    own = f"loomstone_ids_{name.lower()}"
    spark._jsparkSession.udf().register(own, made, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_udf(own, column)


def encoded(spark: SparkSession, raw: Column) -> Column:
    """rangecoder.encode of ids given as little-endian 32-bit numbers in a binary column; ids beyond 2 ** 28 - 1 fail, null stays."""
    return _called(spark, "Encode", raw)


def decoded(spark: SparkSession, data: Column) -> Column:
    """The ids of rangecoder.encode's chunks as little-endian 32-bit numbers in a binary column; a damaged block fails, null stays."""
    return _called(spark, "Decode", data)
