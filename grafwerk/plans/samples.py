"""A file of each language, and what its parser must find: kind, name or owner, place.

Symbols are S kind qualified first-line last-line modifiers, edges E owner kind target line
receiver, imports I path line. The rows are the parser's own, checked line by line by reading.
"""

SAMPLES = {
    "dart": (
        """import 'dart:async';
abstract class Shape { String get id; void area(); }
mixin Mix on Shape { void m() { go(); } }
enum Color { red }
class Foo extends Bar<int> with Mix implements Shape, Other {
    @override
    final String id;
    Map<String, List<int>> cache = {};
    Foo(this.id, String n) : super(n);
    Foo.named(this.id);
    factory Foo.make() { return build(); }
    Future<Map<String, List<int>>> run(
        String key,
        {int x = 1}
    ) async {
        cache.clear();
        return helper(key);
    }
    int short() => other(1);
}
void main() { run(); }
""",
        """
S class sample.Shape 2 2 abstract
S method sample.Shape.area 2 2
S mixin sample.Mix 3 3
S method sample.Mix.m 3 3
S enum sample.Color 4 4
S class sample.Foo 5 20
S property sample.Foo.id 7 7
S property sample.Foo.cache 8 8
S constructor sample.Foo.Foo 9 9
S constructor sample.Foo.named 10 10
S constructor sample.Foo.make 11 11
S method sample.Foo.run 12 15
S method sample.Foo.short 19 19
S function sample.main 21 21
E sample.Mix implements Shape 3
E sample.Mix.m calls go 3
E sample.Foo extends Bar 5
E sample.Foo implements Mix 5
E sample.Foo implements Shape 5
E sample.Foo implements Other 5
E sample.Foo calls build 11
E sample.Foo.run calls clear 16 Map
E sample.Foo.run calls helper 17
E sample.Foo.short calls other 19
E sample.main calls run 21
I dart:async 1
""",
    ),
    "go": (
        """package m
import (
    "fmt"
    ctx "context"
)
type (
    A struct { x int }
    B interface { Run() }
)
type Gen[T any] struct { v T }
func (f *Foo) Run(c ctx.Context, items map[string][]int) (int, error) {
    f.helper()
    fmt.Println(items)
    return 1, nil
}
func Top[T any](x T) *Foo {
    return New(x)
}
""",
        """
S class A 7 7
S interface B 8 8
S class Gen 10 10
S method Run 11 15
S function Top 16 18
E Run calls helper 12 Foo
E Run calls Println 13
E Top calls New 17
I fmt 3
I context 4
""",
    ),
    "java": (
        """package a;
import java.util.List;
import static java.lang.Math.max;
public interface Shape extends Named<String>, Other { double area(); }
@Service
public class Foo<T extends Comparable<T>> extends Base<Integer> implements A, B<C> {
    private final Map<String, List<Integer>> cache = new HashMap<>();
    protected int a = 1, b;
    public Foo(String x) { super(x); init(x); }
    @Override
    public <R> Map<String, List<Integer>> find(
        final String key,
        Map<String, List<T>> other
    ) throws IOException {
        Helper h = new Helper();
        h.run(key);
        this.cache.get(key);
        List<String> l = util.list();
        return Other.call(key);
    }
    abstract void none();
    enum Kind { ONE, TWO }
    static class Inner { void deep() { go(); } }
}
record Point(int x, int y) { int sum() { return add(x, y); } }
""",
        """
S interface Shape 4 4 public
S method Shape.area 4 4
S class Foo 5 24 public
S property Foo.cache 7 7 private final
S property Foo.a 8 8 protected
S property Foo.b 8 8 protected
S method Foo.find 10 20 public
S method Foo.none 21 21 abstract
S enum Foo.Kind 22 22
S class Foo.Inner 23 23 static
S method Foo.Inner.deep 23 23
S class Point 25 25
S method Point.sum 25 25
E Shape extends Named 4
E Shape extends Other 4
E Foo extends Base 6
E Foo implements A 6
E Foo implements B 6
E Foo calls HashMap 7
E Foo.find calls Helper 15
E Foo.find calls run 16 Helper
E Foo.find calls get 17 Map
E Foo.find calls list 18
E Foo.find calls call 19 Other
E Foo.Inner.deep calls go 23
E Point.sum calls add 25
I java.util.List 2
I java.lang.Math.max 3
""",
    ),
    "javascript": (
        """import { emit } from 'events';
export class Queue extends Base {
    #items = [];
    push(item) {
        this.check(item);
        emit('push', item);
    }
}
const size = (q) => q.count();
export default function main() {
    return size(new Queue());
}
""",
        """
S class sample.Queue 2 8
S method sample.Queue.push 4 7
S function sample.size 9 9
S function sample.main 10 12
E sample.Queue extends Base 2
E sample.Queue.push calls check 5 Queue
E sample.Queue.push calls emit 6
E sample.size calls count 9
E sample.main calls size 11
E sample.main calls Queue 11
I events 1
""",
    ),
    "kotlin": (
        """package a.b
import x.y.Thing
import x.z.*

interface Named { val id: String }
enum class Color { RED, GREEN }
open class Base(open val title: String)
data class Item<T : Any>(
    override val id: String,
    private val list: Map<String, List<Int>>,
    plain: Int,
) : Base(id), Named, Comparable<Item<T>> {
    val repo: Repo = Repo()
    fun run(): String {
        val local: Profile = Profile()
        val other = Account(1)
        local.show()
        this.repo.save(id)
        repo.load { it.go() }
        other.close()
        Helper.make()
        return help(title)
    }
    private fun <R> help(
        input: String,
        f: (R) -> Unit = {},
    ): Map<String, List<R>> = convert(input)
    companion object {
        fun of(): Item<Int> = build()
    }
}
fun String.twice() = this + this
""",
        """
S interface Named 5 5
S enum Color 6 6
S class Base 7 7 open
S property Base.title 7 7 open
S class Item 8 31 data
S property Item.id 9 9 override
S property Item.list 10 10 private
S method Item.run 14 23
S method Item.help 24 27 private
S class Item.Companion 28 30 companion
S method Item.Companion.of 29 29
S function twice 32 32
E Item extends Base 8
E Item implements Named 8
E Item implements Comparable 8
E Item calls Repo 13
E Item.run calls Profile 15
E Item.run calls Account 16
E Item.run calls show 17 Profile
E Item.run calls save 18 Repo
E Item.run calls load 19 Repo
E Item.run calls go 19
E Item.run calls close 20 Account
E Item.run calls make 21 Helper
E Item.run calls help 22
E Item.help calls convert 27
E Item.Companion.of calls build 29
I x.y.Thing 2
I x.z.* 3
""",
    ),
    "objc": (
        """#import <Foundation/Foundation.h>
#import "A.h"
@protocol P <NSObject>
@property (nonatomic, copy) NSString *name;
@end
@interface Foo : Bar <P, Q>
@property (nonatomic, assign) int size;
- (instancetype)initWith:(NSString *)a other:(int)b;
+ (void)make;
@end
@implementation Foo
- (instancetype)initWith:(NSString *)a other:(int)b {
    self = [super init];
    _x = [a copy];
    [self go:[Helper make]];
    return self;
}
+ (void)make { NSLog(@"x"); }
@end
@interface Foo (Extra)
- (void)more;
@end
""",
        """
S protocol sample.P 3 5
S property sample.P.name 4 4
S class sample.Foo 6 10
S property sample.Foo.size 7 7
S method sample.Foo.initWith 8 8 instance_method
S method sample.Foo.make 9 9 class_method
S class sample.Foo 11 19
S method sample.Foo.initWith 12 17 instance_method
S method sample.Foo.make 18 18 class_method
S category sample.Extra 20 22
S method sample.Foo.more 21 21 instance_method
E sample.P extends NSObject 3
E sample.Foo extends Bar 6
E sample.Foo implements P 6
E sample.Foo implements Q 6
E sample.Foo.initWith calls init 13
E sample.Foo.initWith calls copy 14
E sample.Foo.initWith calls go 15 Foo
E sample.Foo.initWith calls make 15 Helper
E sample.Foo.make calls NSLog 18
I Foundation/Foundation.h 1
I A.h 2
""",
    ),
    "swift": (
        """import UIKit
protocol P: Q { func need() }
enum E { case a }
final class Foo<T>: Bar, P {
    var svc: Service = Service()
    init(x: Int) { super.init(x: x) }
    func run<U>(
        a: [String: [Int]],
        b: (U) -> Void
    ) throws -> [String: Int] {
        svc.load(a)
        let h = Helper()
        h.go()
        return help(a)
    }
    private static func help(_ a: Any) -> Int { return 1 }
}
extension Foo { func more() { x() } }
""",
        """
S interface P 2 2
S enum E 3 3
S class Foo 4 17 final class
S method Foo.run 7 15
S method Foo.help 16 16 private static
S class Foo 18 18 extension
S method Foo.more 18 18
E P implements Q 2
E Foo implements Bar 4
E Foo implements P 4
E Foo calls Service 5
E Foo calls init 6
E Foo.run calls load 11 Service
E Foo.run calls Helper 12
E Foo.run calls go 13 Helper
E Foo.run calls help 14
E Foo.more calls x 18
I UIKit 1
""",
    ),
    "typescript": (
        """import { a, b } from './mod';
import React from "react";
export interface Shape extends Named { id: string; }
export enum Color { RED = 'r' }
export type Alias<T> = Map<string, T[]> | null;
export abstract class Base<T> { constructor(public name: string) {} }
@Injectable()
export class Foo extends Base<number> implements Shape, Other {
    private items: Map<string, number[]> = new Map();
    static count = 0;
    constructor(private svc: Service, name: string) {
        super(name);
    }
    @Get(':id')
    async find<T>(
        key: string,
        cb: (x: T) => void,
    ): Promise<Map<string, T[]>> {
        this.svc.load(key);
        const other = new Helper();
        other.run();
        return this.items.get(key);
    }
    get size(): number { return this.count(); }
}
export const top = async (x: number): Promise<void> => {
    await doIt(x);
};
const value = 5;
function plain(x) { return helper(x); }
const Comp = () => { return <Foo bar={go()} />; };
""",
        """
S interface sample.Shape 3 3
S enum sample.Color 4 4
S type sample.Alias 5 5
S class sample.Base 6 6 abstract
S method sample.Base.constructor 6 6
S class sample.Foo 8 25 @Injectable()
S property sample.Foo.items 9 9 private
S property sample.Foo.count 10 10 static
S method sample.Foo.constructor 11 13
S method sample.Foo.find 15 23 @Get(':id')
S method sample.Foo.size 24 24
S function sample.top 26 28
S variable sample.value 29 29
S function sample.plain 30 30
S function sample.Comp 31 31
E sample.Shape extends Named 3
E sample.Foo extends Base 8
E sample.Foo implements Shape 8
E sample.Foo implements Other 8
E sample.Foo calls Map 9
E sample.Foo.find calls load 19 Service
E sample.Foo.find calls Helper 20
E sample.Foo.find calls run 21 Helper
E sample.Foo.find calls get 22 Map
E sample.Foo.size calls count 24 Foo
E sample.top calls doIt 27
E sample.plain calls helper 30
E sample.Comp calls go 31
I ./mod 1
I react 2
""",
    ),
}
