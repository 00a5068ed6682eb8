"""Small SQL snippets shared by the SQL counterparts (columns named <prefix>x/y/w/h)."""

from __future__ import annotations


def inter(a: str, b: str) -> str:
    return (
        f"(cast(greatest(0,least({a}x+{a}w,{b}x+{b}w)-greatest({a}x,{b}x)) as bigint)"
        f"*cast(greatest(0,least({a}y+{a}h,{b}y+{b}h)-greatest({a}y,{b}y)) as bigint))"
    )


def area(a: str) -> str:
    return f"(cast({a}w as bigint)*cast({a}h as bigint))"


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(cast({i} as double)/cast({area(a)}+{area(b)}-{i} as double))"


def smaller(a: str, b: str) -> str:
    return f"(cast({inter(a, b)} as double)/cast(least({area(a)},{area(b)}) as double))"


def unit(value: str) -> str:
    return f"(case when {value} is not null then greatest(0e0,least(1e0,{value})) end)"


def crop(x: str, y: str, w: str, h: str, bounded: bool = False, page_w: int = 1000, page_h: int = 1400) -> dict[str, str]:
    if bounded:
        tw = f"least({page_w},greatest(620,least(940,{w}+420)))"
        th = f"least({page_h},greatest(380,least(720,{h}+320)))"
    else:
        tw = f"least({page_w},greatest(700,{w}+240))"
        th = f"least({page_h},greatest(360,{h}+220))"
    left = f"least(greatest(0,{x}-cast(floor(({tw}-{w})/2e0) as int)),{page_w}-{tw})"
    top = f"least(greatest(0,{y}-cast(floor(({th}-{h})/2e0) as int)),{page_h}-{th})"
    return {k: f"cast({v} as int)" for k, v in {"x": left, "y": top, "w": tw, "h": th}.items()}
