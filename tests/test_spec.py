import pytest

from tesselite.plans.spec import CoordinateMode, Extent, Grid, Job, MarkerPolicy, Profile, Scheduling, ServerMode, Settings


@pytest.mark.parametrize("bad", [{"tile_size": 0}, {"min_zoom": -1}, {"min_zoom": 9, "max_zoom": 8}, {"pixels_per_block": 0}, {"pixels_per_block": 3}])
def test_invalid_grids_are_refused(bad):
    with pytest.raises(ValueError):
        Grid(**bad)


def test_other_invalid_settings_are_refused():
    for make in (lambda: Extent(1, 0, 0, 0), lambda: Job("v", "d", 0, 0, 0, 0), lambda: Profile(metatile=0), lambda: Profile(padding_blocks=-1), lambda: Scheduling(capacity=0), lambda: Settings.configured(Profile(quality=0)), lambda: CoordinateMode.parse("elsewhere")):
        with pytest.raises(ValueError):
            make()


def test_resume_is_never_below_pause():
    assert Scheduling(pause_below=19.5, resume_above=19.2).resume_above == 19.5
    assert Scheduling().with_pause_below(19.9).resume_above == 19.9


def test_modes_are_read_in_either_case():
    assert CoordinateMode.parse("Online-Signed") is CoordinateMode.SIGNED
    assert ServerMode.parse("PvE") is ServerMode.PVE
    assert ServerMode.parse("unknown") is ServerMode.SURVIVAL
    assert ServerMode.parse(None) is ServerMode.SURVIVAL


def test_marker_policy():
    assert not MarkerPolicy().allowed
    assert not MarkerPolicy(ServerMode.PVP, "exact").allowed and not MarkerPolicy(ServerMode.WAR, "blurred").allowed
    building = MarkerPolicy(ServerMode.BUILDING, "exact")
    assert building.allowed and not building.blurred and building.delay_ms == 0
    assert MarkerPolicy(ServerMode.SURVIVAL, "exact").blurred and MarkerPolicy(ServerMode.PVE, "exact").delay_ms == 60_000


def test_grid_numbers():
    g = Grid()
    assert g.blocks_at_max == 128 and g.blocks_per_tile(8) == 128 and g.blocks_per_tile(0) == 128 << 8 and g.blocks_per_tile(12) == 128
    assert [g.first_block(8, p) for p in range(4)] == [0, 0, 1, 1]
    assert g.first_block(4, 1) == 8 and g.blocks_per_pixel(4) == 8 and g.blocks_per_pixel(8) == 1
    assert g.padding_pixels(8, 2) == 2 and g.padding_pixels(8, 0) == 1
