"""Small class files, written from their parts."""

import struct


class ClassBuilder:
    def __init__(self, name="a/B", super_name="java/lang/Object", interfaces=(), access=0x21, major=52):
        self.pool, self.index, self.next = [], {}, 1
        self.major, self.access = major, access
        self.this, self.sup = self.cls(name), self.cls(super_name) if super_name else 0
        self.faces = [self.cls(i) for i in interfaces]
        self.fields, self.methods, self.attributes = [], [], []

    def add(self, tag, body, slots=1):
        key = (tag, body)
        if key not in self.index:
            self.index[key] = self.next
            self.pool.append(bytes([tag]) + body)
            self.next += slots
        return self.index[key]

    def utf8(self, text):
        raw = text if isinstance(text, bytes) else text.encode()
        return self.add(1, struct.pack(">H", len(raw)) + raw)

    def cls(self, name):
        return self.add(7, struct.pack(">H", self.utf8(name)))

    def string(self, text):
        return self.add(8, struct.pack(">H", self.utf8(text)))

    def integer(self, v):
        return self.add(3, struct.pack(">i", v))

    def long(self, v):
        return self.add(5, struct.pack(">q", v), 2)

    def float(self, v):
        return self.add(4, struct.pack(">f", v))

    def ref(self, owner, name, desc, tag=10):
        pair = self.add(12, struct.pack(">HH", self.utf8(name), self.utf8(desc)))
        return self.add(tag, struct.pack(">HH", self.cls(owner), pair))

    def attribute(self, name, body):
        return struct.pack(">HI", self.utf8(name), len(body)) + body

    def code(self, code, handlers=(), tables=(), stack=4, slots=8):
        body = struct.pack(">HHI", stack, slots, len(code)) + code + struct.pack(">H", len(handlers))
        body += b"".join(struct.pack(">HHHH", *h) for h in handlers) + struct.pack(">H", len(tables)) + b"".join(tables)
        return self.attribute("Code", body)

    def method(self, name, desc, access=1, attributes=()):
        self.methods.append(struct.pack(">HHHH", access, self.utf8(name), self.utf8(desc), len(attributes)) + b"".join(attributes))

    def field(self, name, desc, access=1, attributes=()):
        self.fields.append(struct.pack(">HHHH", access, self.utf8(name), self.utf8(desc), len(attributes)) + b"".join(attributes))

    def build(self):
        out = struct.pack(">IHHH", 0xCAFEBABE, 0, self.major, self.next) + b"".join(self.pool) + struct.pack(">HHH", self.access, self.this, self.sup)
        out += struct.pack(">H", len(self.faces)) + b"".join(struct.pack(">H", f) for f in self.faces)
        for rows in (self.fields, self.methods, self.attributes):
            out += struct.pack(">H", len(rows)) + b"".join(rows)
        return out
