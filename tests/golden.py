"""Fits of fifteen real wires, kept as fixed values."""

COLUMNS = ("p0", "p1", "p2", "normr", "df", "rsq", "mu_mean", "mu_std")
# One published fit per wire.
WIRES = [
    (0.4820775600446848, 0.08567923250516493, 138.3990064509119, 3.709964916686408, 17698.0, 0.994787644660843, 292648.01489502337, 3.7599808117203652),
    (0.48567367523218063, -0.07150870782978481, 138.43124812838926, 3.8919857040712222, 19465.0, 0.9951356590006224, 292646.6083947918, 3.663766072459332),
    (0.4344985600317219, 0.028422402527423007, 138.450911935594, 4.054785359980781, 20091.0, 0.9941749777419641, 292645.52399658714, 3.5917521057771276),
    (0.32406001049697, 0.007542238539800015, 138.56422041062234, 3.5886796438728115, 18662.0, 0.9900045733172184, 292634.8335074593, 3.1623139451932265),
    (0.34275884948683416, 0.0015220393244172177, 138.39918040892334, 3.1537472932375694, 17205.0, 0.9925801558131592, 292636.9935152772, 3.2022888011129687),
    (0.35011771036789024, 0.1063902795697762, 138.53810902508323, 3.592911075338739, 18733.0, 0.9926068501815156, 292636.1367850664, 3.035141615939462),
    (0.8772103184669948, -0.3783988371407545, 137.6205323774611, 5.4352317277376345, 30431.0, 0.9985981263526968, 292620.4291080436, 5.566530326116837),
    (0.9443100522357168, -0.513715237919369, 137.459594301159, 5.180152398206836, 28850.0, 0.9988318628304392, 292622.5754646478, 5.636463166169795),
    (0.9943079351764038, -0.5807284518573956, 137.53161941125026, 5.176362359327273, 28842.0, 0.9989648123280302, 292621.5826714223, 5.832816046656635),
    (1.1021281852009088, 0.0457978603633589, 138.00470868799758, 4.484533549114814, 33792.0, 0.9992902661260035, 292602.00319061696, 6.026834954572582),
    (1.1465321206938022, 0.06841646884880627, 138.16033326956472, 4.407703464215962, 32903.0, 0.9993459098601013, 292603.1514200269, 6.0436840771261),
    (1.1258687078589107, 0.03756880734484394, 137.9245352788195, 4.748711309412751, 33275.0, 0.9992260205157583, 292604.28426131577, 6.0229612369230345),
    (0.01007707117841127, 0.2925737354278444, 140.27395990214046, 1.7357250715675274, 4597.0, 0.9922106625199296, 292593.37487846694, 0.5290407388766809),
    (0.010422924149409001, 0.30236100100183927, 140.56167418417135, 1.5626681103674291, 4450.0, 0.9938825688499457, 292592.13737293205, 0.5264174706709437),
    (0.01079083430408197, 0.29456851006714035, 140.3350669199678, 1.6125360793187407, 4561.0, 0.9933138119415795, 292590.9774302216, 0.5436697211104397),
]
